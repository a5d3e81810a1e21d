"""Streaming forms: windows, sessions, limits and cooldowns over event streams.

Every function takes a streaming or a batch DataFrame and returns one; the caller picks
the trigger. Event times are cast to timestamps, which watermarks ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder, with ts as a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", c("ts").cast("timestamp"))


def bars(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes", complete: int | None = None) -> DataFrame:
    """Bars per event type and tumbling window; windows with fewer than `complete` events are left out."""
    key = F.struct("ts", "event_id")
    made = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("n")
    )
    return made.where(c("n") >= (complete or 1)).select("event_type", c("w.start").alias("time"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: a gap closes one."""
    made = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    return made.select("user_id", c("w.start").alias("first_ts"), "last_ts", "n")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each user and calendar day in Seoul."""
    day = F.date_format(F.from_utc_timestamp("ts", "Asia/Seoul"), "yyyyMMdd")
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day", "1 day", "15 hours").alias("w"), day.alias("day")).agg(F.count("*").alias("n")).select("user_id", "day", "n")


def over_limit(events: DataFrame, width: str = "1 minute", limit: int = 2, late: str = "5 minutes") -> DataFrame:
    """Users and windows with more events than a fixed-window rate limit lets through."""
    made = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return made.where(c("n") > limit).select("user_id", c("w.start").alias("time"), "n", (c("n") - limit).alias("refused"))


def cooldown(events: DataFrame, seconds: int = 86_400, keys: tuple[str, ...] = ("user_id", "event_type"), late: str = "1 day") -> DataFrame:
    """Events that are the first of their key, or come `seconds` after the last one let through.

    State is one time a key and is dropped once the watermark has passed its cooldown, as
    any event to come is free then. Rows of a micro-batch are taken in order of time; a later
    batch does not undo an earlier one. Events later than `late` are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for t in rows["ts"]:
            now = int(t.value // 1000)
            free = last is None or now - last >= seconds * 1_000_000
            last = now if free else last
            keep.append(free)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, [*keys, "ts", "event_id"]]

    schema = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys) + ", ts timestamp, event_id long"
    rows = events.select(*keys, "ts", "event_id").withWatermark("ts", late)
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is available, then stop; state and progress stay in the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, work, checkpoint: str) -> None:
    """Hand every micro-batch to work(df, id): an idempotent batch job on a schedule."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
