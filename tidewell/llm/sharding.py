"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mixed, repeated, table

#: Rows are numbered within this many hash buckets; their counts are all that is broadcast.
BUCKETS = 4096
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0 .. n - 1.

    A balanced Feistel network permutes the smallest domain of 4**k >= n values; a
    value that falls outside n walks on along its cycle until it is inside. An
    inverse is as cheap, so shard and slot of a row can be computed and undone.
    """

    def __init__(self, n: int, seed: int):
        self.n = max(1, n)
        self.half = max(1, ((self.n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}:{r}".encode(), digest_size=8).digest(), "big")) for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mixed(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._once(np.asarray(x).astype(np.uint64), keys, back)
        while (outside := out >= self.n).any():
            out[outside] = self._once(out[outside], keys, back)
        return out.astype(np.int64)


def numbered(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows with row_number (0 .. n - 1, by content alone) and n_rows.

    Equal rows are counted before they are numbered, so that one row repeated any
    number of times is a single row in the sorts. Buckets by hash bound each sort;
    only the sums of the buckets meet in one task.
    """
    columns = [f"`{c}`" for c in rows.columns]
    bucketed = rows.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    sums = bucketed.groupBy("_bucket").agg(F.sum("_copies").alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(Window.partitionBy(F.lit(1))).alias("n_rows"))
    inside = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bucketed.withColumn("_end", F.sum("_copies").over(inside)).join(F.broadcast(offsets), "_bucket")
    first = F.col("_offset") + F.col("_end") - F.col("_copies")
    each = repeated(placed.withColumn("_first", first), F.col("_copies"), "_nth")
    return each.select(*columns, (F.col("_first") + F.col("_nth")).alias("row_number"), "n_rows")


def shard(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """rows with row_number, n_rows, shard (0 .. shards - 1) and slot (gapless from 0 in its shard).

    The law is `rows`: the permuted number p goes to shard p mod shards, slot
    p div shards, so that counts differ by one at most. The same rows in any order or
    partitioning give the same result. All columns of rows decide the numbers, nulls
    included; equal rows take a place each. Fewer rows than shards leave shards empty;
    an empty table gives an empty result.
    """

    @F.pandas_udf("long")
    def permuted(number: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(Feistel(int(n.iloc[0]), seed)(number.to_numpy()) if len(n) else [], dtype="int64")

    placed = numbered(rows).withColumn("_p", permuted("row_number", "n_rows"))
    return placed.withColumns({"shard": F.expr(f"int(_p % {shards})"), "slot": F.expr(f"_p div {shards}")}).drop("_p")


def shard_keys(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16) and text_crc32 of each row, and more columns as they are."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *more)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """The documents with all columns, shard and slot, which replace columns of these names; documents
    that share key, size and checksum take the slots of their group in any order."""
    docs = docs.drop("shard", "slot")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(F.struct("*").alias("_whole"), "doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    same = Window.partitionBy("doc_id", "size", "text_crc32")
    keyed = keyed.withColumn("_nth", F.row_number().over(same.orderBy("size")))
    places = shard(shard_keys(docs), shards, seed).withColumn("_nth", F.row_number().over(same.orderBy("row_number")))
    on = [keyed["doc_id"].eqNullSafe(places["doc_id"]), keyed["size"] == places["size"], keyed["text_crc32"] == places["text_crc32"], keyed["_nth"] == places["_nth"]]
    return keyed.join(places, on).select("_whole.*", places["shard"].alias("shard"), places["slot"].alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    placed = shard(shard_keys(table(spark, sf_dir, "documents")), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
