"""Writes as differences of tables: what a load inserts, changes, skips and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """old and new rows, of each key the one with the highest version (new wins ties)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_new")


def load_plan(old: DataFrame, new: DataFrame, scope: str | None = None) -> DataFrame:
    """id and action (insert, embed, metadata, skip, delete) of an idempotent load of passages.

    Both sides have id, sha and meta. Equal hashes with other metadata are updated in
    place; ids missing from new are deleted, with a scope column only within scopes that
    new touches.
    """
    o = old.select("id", F.col("sha").alias("o_sha"), F.col("meta").alias("o_meta"), *([F.col(scope).alias("_s")] if scope else []))
    n = new.select("id", F.col("sha").alias("n_sha"), F.col("meta").alias("n_meta"))
    if scope:
        o = o.join(new.select(F.col(scope).alias("_s")).distinct(), "_s", "left_semi").drop("_s")
    action = (
        F.when(F.col("o_sha").isNull(), "insert").when(F.col("n_sha").isNull(), "delete").when(F.col("o_sha") != F.col("n_sha"), "embed")
        .when(~F.col("o_meta").eqNullSafe(F.col("n_meta")), "metadata").otherwise("skip")
    )
    return o.join(n, "id", "full_outer").select("id", action.alias("action"))


def fresh(cache: DataFrame, now: Column, max_age: str) -> DataFrame:
    """Cache rows not older than max_age."""
    return cache.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {max_age}"))


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines; the committer renames finished files only."""
    df.write.mode("overwrite").json(path)
