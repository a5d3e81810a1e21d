"""Candle patterns, pivot levels and breakouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import rolling as R

from .indicators import bollinger, last_bar
from .ordered import fold

#: Which way each pattern points.
DIRECTIONS = {
    "doji": 0, "bullish_marubozu": 1, "bearish_marubozu": -1, "hammer": 1, "hanging_man": -1, "inverted_hammer": 1, "shooting_star": -1, "bullish_engulfing": 1,
    "bearish_engulfing": -1, "morning_star": 1, "evening_star": -1, "three_white_soldiers": 1, "three_black_crows": -1,
}


def anatomy(df: DataFrame) -> DataFrame:
    """df with range, body, body_pct, upper, lower, bull and bear of each bar."""
    c = F.col
    df = df.withColumns({"range": F.greatest(c("high") - c("low"), F.lit(1e-9)), "body": F.abs(c("close") - c("open")), "bull": c("close") > c("open"), "bear": c("close") < c("open")})
    return df.withColumns({"body_pct": c("body") / c("range"), "upper": c("high") - F.greatest("open", "close"), "lower": F.least("open", "close") - c("low")})


def candle_patterns(df: DataFrame, lookback: int | None = None) -> DataFrame:
    """symbol, time, bars_ago and pattern: a row for each pattern of each bar.

    Bars 1 to 3 of a symbol and symbols under 25 bars have none. With lookback only the
    last bars of a symbol are reported; the patterns themselves see past bars only.
    """
    c = F.col
    df = anatomy(df).withColumns({"mean_body": F.coalesce(R.sma("body", 20), "body"), "_t": R.pct_change("close", 5), "_i": F.row_number().over(R.order()), "_n": F.count("*").over(Window.partitionBy("symbol"))})
    kept = ("open", "close", "body", "body_pct", "bull", "bear")
    df = df.withColumns({**{f"{x}{k}": F.lag(x, k).over(R.order()) for x in kept for k in (1, 2)}, "_up": F.coalesce(F.lag("_t").over(R.order()), F.lit(0.0))})
    small, ab, middle = c("body_pct") <= 0.35, c("mean_body"), (c("open2") + c("close2")) / 2
    low_tail = small & (c("lower") >= 2 * c("body")) & (c("upper") <= c("body"))
    high_tail = small & (c("upper") >= 2 * c("body")) & (c("lower") <= c("body"))
    long_bar = (c("body_pct") > 0.1) & (c("body_pct") >= 0.9) & (c("body") >= ab)
    star = (c("body2") > ab) & (c("body1") < ab * 0.5) & (c("body") > ab)
    full = F.least("body_pct", "body_pct1", "body_pct2") > 0.5
    rising = c("_up") > 0.03
    tests = {
        "doji": c("body_pct") <= 0.1,
        "bullish_marubozu": long_bar & c("bull"),
        "bearish_marubozu": long_bar & ~c("bull"),
        "hammer": low_tail & ~rising,
        "hanging_man": low_tail & rising,
        "inverted_hammer": high_tail & ~rising,
        "shooting_star": high_tail & rising,
        "bullish_engulfing": c("bull") & c("bear1") & (c("close") >= c("open1")) & (c("open") <= c("close1")) & (c("body") > c("body1")),
        "bearish_engulfing": c("bear") & c("bull1") & (c("open") >= c("close1")) & (c("close") <= c("open1")) & (c("body") > c("body1")),
        "morning_star": c("bear2") & star & c("bull") & (c("close") > middle),
        "evening_star": c("bull2") & star & c("bear") & (c("close") < middle),
        "three_white_soldiers": c("bull") & c("bull1") & c("bull2") & (c("close") > c("close1")) & (c("close1") > c("close2")) & full,
        "three_black_crows": c("bear") & c("bear1") & c("bear2") & (c("close") < c("close1")) & (c("close1") < c("close2")) & full,
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    df = df.withColumn("bars_ago", c("_n") - c("_i")).where((c("_n") >= 25) & (c("_i") > 3))
    if lookback:
        df = df.where(c("bars_ago") < lookback)
    return df.select("symbol", "time", "bars_ago", F.explode(found).alias("pattern"))


def pivots(df: DataFrame, window: int = 5, lookback: int | None = None) -> DataFrame:
    """symbol, time, price and kind (high, low) of bars that are the extreme of `window` bars on both sides."""
    df = last_bar(df, lookback) if lookback else df
    frame = R.order().rowsBetween(-window, window)
    df = df.withColumns({"_hi": F.max("high").over(frame), "_lo": F.min("low").over(frame), "_n": F.count("*").over(frame)}).where(F.col("_n") == 2 * window + 1)
    marks = F.array_compact(F.array(F.when(F.col("high") == F.col("_hi"), F.struct(F.col("high").alias("price"), F.lit("high").alias("kind"))), F.when(F.col("low") == F.col("_lo"), F.struct(F.col("low").alias("price"), F.lit("low").alias("kind")))))
    return df.select("symbol", "time", F.explode(marks).alias("p")).select("symbol", "time", "p.price", "p.kind")


def levels(df: DataFrame, lookback: int = 120, tolerance: float = 1.0, most: int = 6, window: int = 5) -> DataFrame:
    """Support and resistance: symbol, price, type, touches, distance (percent), rank by touches, nearest.

    Pivot prices in ascending order join the first cluster whose running mean lies within
    the tolerance in percent, or start one.
    """

    def segment(state, rows):
        clusters = state or []
        at = []
        for price in rows["price"]:
            for k, (mean, n) in enumerate(clusters):
                if abs(price - mean) / mean * 100 <= tolerance:
                    clusters[k] = ((mean * n + price) / (n + 1), n + 1)
                    at.append(k)
                    break
            else:
                clusters.append((price, 1))
                at.append(len(clusters) - 1)
        return clusters, rows.assign(cluster=pd.Series(at, index=rows.index, dtype="int64"))

    placed = fold(pivots(df, window, lookback), ["symbol"], ["price", "kind"], "cluster long", segment)
    last = df.groupBy("symbol").agg(F.max_by("close", "time").alias("last"))
    found = placed.groupBy("symbol", "cluster").agg(F.avg("price").alias("price"), F.count("*").alias("touches")).join(last, "symbol")
    distance = F.round((F.col("price") / F.col("last") - 1) * 100, 2)
    found = found.withColumns({"type": F.when(F.col("price") < F.col("last"), "support").otherwise("resistance"), "distance": distance})
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("touches"), F.abs("distance"), "price"))
    found = found.withColumn("place", place).where(F.col("place") <= most)
    side = Window.partitionBy("symbol", "type")
    nearest = F.when(F.col("type") == "support", F.col("price") == F.max("price").over(side)).otherwise(F.col("price") == F.min("price").over(side))
    strength = F.when(F.col("touches") >= 3, "strong").when(F.col("touches") == 2, "medium").otherwise("weak")
    return found.select("symbol", F.round("price", 2).alias("price"), "type", "touches", "distance", strength.alias("strength"), "place", nearest.alias("nearest"))


def breakouts(df: DataFrame) -> DataFrame:
    """symbol, key, direction, confirmed and bars_ago of the last bar's events, for symbols of 65 bars or more."""
    c = F.col
    df = bollinger(df).withColumns({
        "hi20": F.max("close").over(R.prior_rows(20)), "lo20": F.min("close").over(R.prior_rows(20)), "hi252": F.max("close").over(R.last_rows(252)), "lo252": F.min("close").over(R.last_rows(252)),
        "vol20": F.avg("volume").over(R.last_rows(20)), "_a": R.sma("close", 20), "_b": R.sma("close", 60), "_i": F.row_number().over(R.order()), "_n": F.count("*").over(Window.partitionBy("symbol")),
    })
    df = df.withColumns({"_up": R.crossover("_a", "_b"), "_down": R.crossunder("_a", "_b")})
    ago = lambda x: c("_i") - F.max(F.when(c(x), c("_i"))).over(R.last_rows(5))
    df = df.withColumns({"_up_ago": ago("_up"), "_down_ago": ago("_down"), "_loud": c("volume") / F.greatest("vol20", F.lit(1e-9)) >= 1.5})
    event = lambda test, key, way, confirmed, back=F.lit(0): F.when(test, F.struct(F.lit(key).alias("key"), F.lit(way).alias("direction"), confirmed.alias("confirmed"), back.cast("int").alias("bars_ago")))
    yes, no = F.lit(True), F.lit(False)
    events = F.array_compact(F.array(
        event(c("close") > c("hi20"), "breakout_20d", 1, c("_loud")), event(c("close") < c("lo20"), "breakdown_20d", -1, c("_loud")),
        event(c("close") >= c("hi252"), "high_52w", 1, yes), event(c("close") <= c("lo252"), "low_52w", -1, yes),
        event(c("_up_ago").isNotNull(), "golden_cross", 1, yes, c("_up_ago")), event(c("_down_ago").isNotNull(), "dead_cross", -1, yes, c("_down_ago")),
        event(c("close") > c("bb_upper"), "bb_upper_break", -1, no), event(c("close") < c("bb_lower"), "bb_lower_break", 1, no),
    ))
    return last_bar(df).where("_n >= 65").select("symbol", F.explode(events).alias("e")).select("symbol", "e.*")


def level_breaks(df: DataFrame, found: DataFrame) -> DataFrame:
    """Levels that the last bar's close passed."""
    last = last_bar(df.withColumns({"before": R.shift("close"), "loud": F.col("volume") / F.greatest(F.avg("volume").over(R.last_rows(20)), F.lit(1e-9)) >= 1.5})).select("symbol", F.col("close").alias("last"), "before", "loud")
    way = F.when((F.col("before") <= F.col("price")) & (F.col("last") > F.col("price")), 1).when((F.col("before") >= F.col("price")) & (F.col("last") < F.col("price")), -1)
    return found.join(last, "symbol").withColumn("direction", way).where("direction is not null").select("symbol", F.when(F.col("direction") == 1, "resistance_break").otherwise("support_break").alias("key"), "price", "direction", F.col("loud").alias("confirmed"))


def pattern_score(df: DataFrame, lookback: int = 5) -> DataFrame:
    """Sum of directions of recent patterns (1, or 0.5 before the last bar) and events (1.5 confirmed, else 1), and the bias."""
    way = F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv])
    one = candle_patterns(df, lookback).select("symbol", (F.when(F.col("bars_ago") == 0, 1.0).otherwise(0.5) * F.try_element_at(way, F.col("pattern"))).alias("w"))
    weight = F.when(F.col("confirmed"), 1.5).otherwise(1.0) * F.col("direction")
    two = breakouts(df).select("symbol", weight.alias("w"))
    three = level_breaks(df, levels(df)).select("symbol", weight.alias("w"))
    summed = df.select("symbol").distinct().join(one.union(two).union(three).groupBy("symbol").agg(F.sum("w").alias("score")), "symbol", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return summed.withColumn("bias", F.when(F.col("score") >= 1, "bullish").when(F.col("score") <= -1, "bearish").otherwise("neutral"))
