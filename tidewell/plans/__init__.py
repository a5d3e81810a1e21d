"""Whole queries over the test tables; importing this package registers them."""

from . import accounts, evidence, facts, filing_tables, formulas, ingest, models, relational, retrieval, statistics, streams, studies, technical
from .backtests import flagship

__all__ = ["accounts", "evidence", "facts", "filing_tables", "flagship", "formulas", "ingest", "models", "relational", "retrieval", "statistics", "streams", "studies", "technical"]
