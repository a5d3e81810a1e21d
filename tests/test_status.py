"""Runs that end by a word of their own or by a timer: stream against batch and by hand."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.streaming import status

T0 = datetime(2024, 1, 1)
SHAPE = "run_id string, ts timestamp, status string"

#: (run, seconds, status) of the files of a stream, in their order.
FILES = [
    [("done", 0, "running"), ("late", 0, "pending"), ("turned", 50, "done"), ("tie", 0, "running"), ("told", 0, "running"), (None, 1, "running")],
    [("done", 30, "done"), ("done", 40, "failed"), ("late", 60, "done"), ("turned", 0, "running"), ("tie", 9, "failed"), ("tie", 9, "done"), ("quiet", 5, "running"), ("quiet", None, "done")],
    [("clock", 4000, "running")],
    [("told", 3900, "done"), ("new", 3990, "failed")],
    [("clock", 9000, "running")],
]
WANTED = {
    "done": ("done", None, 0, 30), "late": ("failed", "stale", 0, 60), "turned": ("done", None, 0, 50), "tie": ("done", None, 0, 9), "told": ("failed", "stale", 0, 60),
    "quiet": ("failed", "stale", 5, 65), "clock": ("failed", "stale", 4000, 4060), "new": ("failed", None, 3990, 3990),
}


def frame(spark, rows):
    return spark.createDataFrame([(r, None if s is None else T0 + timedelta(seconds=s), w) for r, s, w in rows], SHAPE)


def found(df):
    rows = df.collect()
    out = {r.run_id: (r.status, r.error, (r.created - T0).total_seconds(), (r.finished - T0).total_seconds()) for r in rows}
    assert len(out) == len(rows)
    return out


def test_batch(spark):
    every = frame(spark, [r for f in FILES for r in f])
    assert found(status.ended_runs(every)) == WANTED
    assert status.ended_runs(every.limit(0)).count() == 0
    assert "ghost" not in found(status.ended_runs(every.union(frame(spark, [("ghost", 8950, "running")])))), "its limit is to come"


def test_stream_by_timers_equals_batch(spark, tmp_path):
    source, name = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    for i, rows in enumerate(FILES):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        newest = max((f for f in os.scandir(source) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest.path, (1_700_000_000 + 10 * i,) * 2)
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
        sink = status.ended_runs(stream, late="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert found(spark.read.parquet(str(tmp_path / "out"))) == WANTED
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("run_id") == "told").count() == 1
