"""Relational operators: matching, carrying forward, resampling, sessions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def unique_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left with the value of its key's only match; null where a key has several values or none."""
    one = right.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_top")).where(F.col(value) == F.col("_top")).drop("_top")
    return left.join(one, key, "left")


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with present: whether right has its key. Keys are made distinct before the join, so no row doubles."""
    marks = right.select(key).distinct().withColumn("present", F.lit(True))
    return left.join(marks, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with the last value before each row: a backward as-of over earlier rows of its key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_v", value).withColumn(out, F.last("_v", ignorenulls=True).over(before)).drop("_v")


def mean_of_all(x: Column) -> Column:
    """Sum over all rows of a group, nulls as 0, by the number of rows."""
    return F.sum(F.coalesce(x, F.lit(0))) / F.count("*")


def grouped_report(stats: DataFrame, by: list[str], allowed: set[str], condition: Column, most: int) -> DataFrame:
    """Counts and the plain mean of means by validated columns, largest first."""
    if bad := set(by) - allowed:
        raise ValueError(f"no grouping by {sorted(bad)}")
    return stats.where(condition).groupBy(*by).agg(F.sum("cnt").alias("cnt"), F.round(F.avg("score"), 4).alias("score")).orderBy(F.desc("cnt"), *by).limit(most)


def resample(bars: DataFrame, width: str, complete: int | None = None) -> DataFrame:
    """Bars of a wider period; with `complete`, periods with fewer bars are left out."""
    wide = bars.groupBy("symbol", F.window("time", width).alias("w")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("_n")
    )
    return wide.where(F.col("_n") == complete if complete else F.lit(True)).select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def seasonality(returns: DataFrame, season: Column, name: str) -> DataFrame:
    """Mean, sample deviation and number of returns by symbol and season."""
    return returns.where("ret is not null").groupBy("symbol", season.cast("int").alias(name)).agg(F.round(F.avg("ret"), 8).alias("mean"), F.round(F.stddev_samp("ret"), 8).alias("std"), F.count("ret").alias("n"))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of every listed value, 0 where none came."""
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return listed.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def sessions(df: DataFrame, key: str, time: str, tie: str, gap: str) -> DataFrame:
    """First and last time and rows of each session; a gap of at least `gap` starts one."""
    order = Window.partitionBy(key).orderBy(time, tie)
    fresh = F.coalesce((F.col(time) - F.lag(time).over(order) >= F.expr(f"INTERVAL {gap}")).cast("int"), F.lit(1))
    numbered = df.withColumn("_f", fresh).withColumn("_k", F.sum("_f").over(order))
    return numbered.groupBy(key, "_k").agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count("*").alias("n")).drop("_k")


def trade_metrics(trades: DataFrame, key: str, order: list[str], r: str) -> DataFrame:
    """Compound return, drawdown from a peak that starts at 1, win rate and mean of a key's trades in order."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    eq = trades.withColumn("_eq", F.product(1 + F.col(r)).over(upto))
    dd = eq.withColumn("_dd", F.col("_eq") / F.greatest(F.lit(1.0), F.max("_eq").over(upto)) - 1)
    return dd.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.product(1 + F.col(r)) - 1, 6).alias("total"), F.round(F.min("_dd"), 6).alias("mdd"),
        F.round(F.count_if(F.col(r) > 0) / F.count("*"), 6).alias("win_rate"), F.round(F.avg(r), 8).alias("mean"),
    )


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df; its query fails if a key comes twice. One row for each key is shuffled for the test."""
    twice = df.groupBy(key).count().agg(F.max("count").alias("_most"))
    checked = twice.select(F.when(F.coalesce("_most", F.lit(0)) <= 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{key} is not unique")).cast("boolean")).alias("_ok"))
    return df.crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with number: 0, 1, ... in the given order, over all rows; rows are dealt out by ranges, so no task orders all.

    Rows that are equal in the order are numbered arbitrarily.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    runs = placed.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = runs.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.withColumn("_part", part).join(shifts, "_part").withColumn("number", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
