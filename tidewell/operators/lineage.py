"""Lineage cuts: tables written to the shared checkpoint folder and read back."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that are not deleted yet, in the order in which they were written.
_TABLES: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back, which cuts its lineage.

    The folder is the one the cluster names in spark.checkpoint.dir; only in local mode
    (tests, a laptop) may it be unset, and a temporary one is taken. Lost executors lose
    nothing of it. The table is compressed, unlike a checkpoint, and deleted by `release`
    or when the driver ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `release`."""
    return len(_TABLES)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables written since a mark but for the last `keep`, as nothing reads them any more."""
    for path in _TABLES[since : len(_TABLES) - keep]:
        _delete(spark, path)
        _TABLES.remove(path)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewell-")


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
