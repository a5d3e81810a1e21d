"""Tidewell: a PySpark-native analytics engine for investment research data."""
