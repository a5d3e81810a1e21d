"""Status of runs: a run ends by a last word of its own, or as stale when none comes in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

c = F.col

SCHEMA = "run_id {key}, status string, error string, created long, finished long"


class _Runs(StatefulProcessor):
    """State of a run: creation, its first last word, and whether it was told; times in microseconds."""

    def __init__(self, last: tuple[str, ...], micros: int, forget: int):
        self.last, self.micros, self.forget = last, micros, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "created long, ended long, status string, told boolean")

    def _wake(self, created: int) -> None:
        self.handle.registerTimer(-(-(created + self.micros) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        created, ended, status, told = self.run.get() if self.run.exists() else (None, None, None, False)
        if not told:
            before = created
            for batch in rows:
                for at, word in zip(batch["us"], batch["status"], strict=True):
                    created = int(at) if created is None else min(created, int(at))
                    if word in self.last and (ended is None or (int(at), word) < (ended, status)):
                        ended, status = int(at), word
            if created is not None:
                self.run.update((created, ended, status, False))
                if created != before:
                    self._wake(created)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, ended, status, told = self.run.get() if self.run.exists() else (None, None, None, None)
        due = created is not None and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= created + self.micros
        if told:
            if expiredTimerInfo.getExpiryTimeInMs() * 1000 >= created + self.micros + self.forget:
                self.run.clear()
        elif due:
            self.run.update((created, ended, status, True))
            self.handle.registerTimer(-(-(created + self.micros + self.forget) // 1000))
            kept = ended is not None and ended < created + self.micros
            end = ended if kept else created + self.micros
            yield pd.DataFrame({"run_id": [key[0]], "status": [status if kept else "failed"], "error": [None if kept else "stale"], "created": [created], "finished": [end]})

    def close(self) -> None:
        pass


def ended_runs(events: DataFrame, last: tuple[str, ...] = ("done", "failed"), seconds: int = 60, late: str = "10 minutes", forget: int = 86_400) -> DataFrame:
    """One row of each run whose time is over: run_id, status, error, created, finished.

    events have run_id, ts (timestamp) and status. A run is created by its earliest event. The
    earliest event of a `last` status less than `seconds` after it ends the run (of equal times
    the smaller word counts); without one the run is failed, with error stale, at its limit.
    A stream tells of a run once the watermark has passed its limit, by a timer, so the order and
    the batches in which events come change nothing, but for events later than `late`; what comes
    of a run after that is left out, and its state is dropped `forget` seconds later. A batch tells
    of the runs whose limit lies at or before its latest event. Rows without id, time or status are left out.
    A stream asks for the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = events.select("run_id", c("ts").cast("timestamp").alias("ts"), "status").dropna()
    if rows.isStreaming:
        shape = SCHEMA.format(key=rows.schema["run_id"].dataType.simpleString())
        watched = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late).groupBy("run_id")
        told = watched.transformWithStateInPandas(_Runs(last, seconds * 1_000_000, forget * 1_000_000), shape, "Append", "EventTime")
        return told.withColumns({x: F.timestamp_micros(x) for x in ("created", "finished")})
    limit = c("created") + F.make_dt_interval(secs=F.lit(seconds))
    word = F.when(c("status").isin(*last), F.struct("ts", "status"))
    runs_ = rows.groupBy("run_id").agg(F.min("ts").alias("created"), F.min(word).alias("w"))
    latest = rows.agg(F.max("ts").alias("_now"))
    over = runs_.crossJoin(F.broadcast(latest)).where(limit <= c("_now"))
    kept = c("w").isNotNull() & (c("w.ts") < limit)
    return over.select("run_id", F.when(kept, c("w.status")).otherwise("failed").alias("status"), F.when(~kept, "stale").alias("error"), "created", F.when(kept, c("w.ts")).otherwise(limit).alias("finished"))
