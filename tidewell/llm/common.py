"""Helpers that several training-data operators share: tables, words, hashes, lineage cuts."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.lineage import cut, mark, release

__all__ = ["Rolling", "WordHashes", "cut", "encoded", "mark", "may_be_in", "mixed", "pieces", "release", "repeated", "table", "words_of"]

#: Java class of the white space that separates words in the contracts (\x09-\x0D and space).
SPACE = r"[\x09-\x0D\x20]+"
#: Distinct words a task keeps hashed; the table is emptied when it is full, which changes no result.
MEMO_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of white-space separated words; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: Rows that one array stands for at most where rows are repeated.
STRIDE = 16_384


def repeated(df: DataFrame, times: Column, name: str) -> DataFrame:
    """df with each row as often as `times` says and a column that numbers them from 0; no long array for a hot row."""
    strides = F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), ((times - 1) / STRIDE).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    spread = df.withColumns({"_times": times.cast("long"), "_stride": strides})
    inner = F.sequence(F.col("_stride") * STRIDE, F.least(F.col("_times"), (F.col("_stride") + 1) * STRIDE) - 1)
    return spread.withColumn(name, F.explode(inner)).drop("_times", "_stride")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), so that equal low bits mean nothing."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, kept per task."""

    def __init__(self, seed: int = 0):
        self.seed, self.seen = seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen, seed = self.seen, self.seed
        if len(seen) > MEMO_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w, seed)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all runs of `length` words: a polynomial over the word hashes modulo 2**64."""

    def __init__(self, length: int, base: int):
        self.length = length
        self.base, self.inverse = np.uint64(base | 1), np.uint64(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse)])

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - self.length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._powers(len(hashes))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64)])
            return mixed((sums[self.length :] - sums[:n]) * self.down[:n])


def encoded(df: DataFrame, *keep: str, text: str = "text", as_name: str = "body") -> DataFrame:
    """The kept columns and the text as UTF-8 bytes (null text: empty), for Arrow tasks."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(as_name))


def pieces(batches, column: str = "body", size: int = 4 << 20):
    """Arrow batches cut so that one piece holds about `size` bytes of the column, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Bits in one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32_768


def may_be_in(df: DataFrame, key: Column, members: DataFrame, member: Column, bitmaps: int = 512, name: str = "maybe") -> DataFrame:
    """df with a boolean column that is true for every key among the members, and for few others.

    A hashed bitmap of fixed size (bitmaps x 4 KB, so a proven bound) is built by
    an aggregation and broadcast. It only spares rows a shuffle: what passes it is
    joined exactly afterwards, so a full bitmap costs time and changes no result.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bitmaps * BITMAP_BITS))
    maps = members.select(bit(member).alias("_bit")).groupBy(F.expr(f"_bit div {BITMAP_BITS}").alias("_map")).agg(F.expr(f"bitmap_construct_agg(_bit % {BITMAP_BITS})").alias("_bits"))
    held = df.withColumn("_key", bit(key)).withColumn("_at", F.expr(f"_key div {BITMAP_BITS}"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int((_key % {BITMAP_BITS}) div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, int(_key % 8)) & 1") == 1
    joined = held.join(F.broadcast(maps), F.col("_at") == F.col("_map"), "left").withColumn("_byte", byte)
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_key", "_at", "_map", "_bits", "_byte")
