"""Vector code compression: a small integer codebook for each part of the vectors, by Hamerly's bounds.

Every round assigns each part of each vector to its nearest codebook entry and moves the
entries to the floor of their means. A written table carries, for each part, its entry
with an upper bound of the distance to it and one lower bound of the distance to the
second nearest; the entries' moves widen them. Only where the bounds fail to be strictly
apart is a part compared with all entries, in integers, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mark, release, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers up to this size have exact 64-bit squared distances; beyond it Python's own integers are used.
EXACT = 1 << 27
#: Rows that are compared with all entries at once.
SCAN = 2048
#: Relative slack of a computed distance.
SLACK = 1e-12
#: Sums by label up to so many rows are broadcast.
MOST_LABELS = 100_000
SPREAD = 32


class Codebooks:
    """Entries (parts x entries x width, integers) with what the bounds need of them and of their last moves."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        parts, k, _ = entries.shape
        apart = np.sqrt(squares(entries[:, :, None], entries[:, None]).astype(np.float64))
        apart[:, np.arange(k), np.arange(k)] = np.inf
        #: Below half the way to the next entry no other one is as near.
        self.half = apart.min(2) / 2 * (1 - SLACK)
        moved = np.zeros((parts, k)) if before is None else np.sqrt(squares(entries, before).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        others = np.repeat(moved[:, None], k, 1)
        others[:, np.arange(k), np.arange(k)] = 0
        #: How far any other entry has come at most.
        self.others = others.max(2)

    def assign(self, x: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entry, upper and lower bound of each part of x (rows x parts x width), and how many parts were scanned."""
        n, parts, _ = x.shape
        if held is None:
            code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts))
        else:
            code, upper, lower = (a.copy() for a in held)
        scanned = 0
        for p in range(parts):
            entries, own, up, low = self.entries[p], code[:, p], upper[:, p], lower[:, p]
            up += self.moved[p][own]
            low -= self.others[p][own]
            bound = np.maximum(low, self.half[p][own])
            open_ = np.flatnonzero(~(up < bound))
            if held is not None and len(open_):
                up[open_] = np.sqrt(squares(x[open_, p], entries[own[open_]]).astype(np.float64)) * (1 + SLACK)
                open_ = open_[~(up[open_] < bound[open_])]
            scanned += len(open_)
            for start in range(0, len(open_), SCAN):
                rows = open_[start : start + SCAN]
                all_ = squares(x[rows, p][:, None], entries[None])
                own[rows] = nearest = all_.argmin(1)
                at = np.arange(len(rows))
                up[rows] = np.sqrt(all_[at, nearest].astype(np.float64)) * (1 + SLACK)
                apart = np.sqrt(all_.astype(np.float64))
                apart[at, nearest] = np.inf
                low[rows] = apart.min(1) * (1 - SLACK)
        return code, upper, lower, scanned

    def errors(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return sum((squares(x[:, p], self.entries[p][code[:, p]]) for p in range(x.shape[1])), np.zeros(len(x), x.dtype))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    d = a - b
    return (d * d).sum(-1)


def integers(values: np.ndarray, rows: int) -> np.ndarray:
    """Values as rows x parts x width, in 64 bits where squared distances stay exact."""
    kind = np.int64 if not len(values) or max(int(values.max()), -int(values.min())) < EXACT else object
    return values.astype(kind).reshape(rows, PARTS, -1)


def _outwards(bounds: np.ndarray, way: float) -> np.ndarray:
    return np.nextafter(bounds.astype(np.float32), np.float32(way))


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return integers(batch.column("parts").flatten().to_numpy(zero_copy_only=False), batch.num_rows)


def _held(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1)
    return read("code", np.uint8).astype(np.int64), read("upper", np.float32).astype(np.float64), read("lower", np.float32).astype(np.float64)


def _rows(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def _assigned(books: Codebooks, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _values(batch)
            code, upper, lower, _ = books.assign(x, None if first else _held(batch))
            codes = _rows(code.astype(np.uint8))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("row"), codes, pa.array(books.errors(x, code).tolist(), pa.int64())], ["row", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("parts"), codes, _rows(_outwards(upper, np.inf)), _rows(_outwards(lower, -np.inf))], ["row", "parts", "code", "upper", "lower"])

    return run


def _sums(width: int, entries: int):
    """part, entry, number of parts assigned to it and their sums; a row for each entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, PARTS, -1)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for p in range(PARTS):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

    return run


def _means(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floors of their parts' means; those without parts stay. The driver gets one row for each number of the codebooks."""
    parts, entries, width = books.entries.shape
    each = state.select("parts", "code").mapInArrow(_sums(width, entries), "part int, entry int, n long, sums array<long>")
    each = each.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    moved = books.entries.copy()
    for r in each.groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect():
        moved[r["part"], r["entry"], r["at"]] = int(r["sum"]) // int(r["n"])
    return Codebooks(moved, books.entries)


def prepared(vectors: DataFrame, vector: str, *keep: str) -> DataFrame:
    """row (the kept columns) and parts (integers) of the vectors that have only finite components."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    usable = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0) & F.coalesce(finite, F.lit(False)))
    return usable.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int")).alias("parts"))


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error), and the codebooks behind the codes (None where no vector is kept).

    vectors needs vec_id, label and the vector; other columns are ignored. Vectors that
    are null, empty or hold null or non-finite components are dropped, and so are those
    whose length is no multiple of 8 or differs from that of the kept vector with the
    smallest vec_id, as their parts have no counterpart. The codebooks start from the 16
    smallest vec_ids (fewer vectors: fewer entries; of one vec_id the smaller vector
    first; null last), equal entries included. Repeated rows count and are returned each.
    Integers of 32 bits and more are an error. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    since = mark()
    state = cut(prepared(vectors, vector, "vec_id", "label"))
    smallest = lambda df, n: df.orderBy(F.col("row.vec_id").asc_nulls_last(), "parts").select("parts").limit(n).collect()
    start = smallest(state, 1)
    if not start:
        return state.select("row.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), None
    state = state.where(F.size("parts") == len(start[0][0]))
    first = np.array([r[0] for r in smallest(state, ENTRIES)], np.int64)
    books = Codebooks(integers(first.ravel(), len(first)).transpose(1, 0, 2))
    shape = f"row {state.schema['row'].dataType.simpleString()}, "
    for k in range(rounds):
        state = cut(state.mapInArrow(_assigned(books, k == 0, False), f"{shape}parts array<int>, code binary, upper binary, lower binary"))
        release(spark, since, keep=1)
        books = _means(state, books)
    coded = cut(state.mapInArrow(_assigned(books, rounds == 0, True), f"{shape}code binary, error long"))
    release(spark, since, keep=1)
    return coded.select("row.*", F.lower(F.hex("code")).alias("code"), "error"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (a written table) with label_error: the errors summed over rows of the same label, nulls together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    if sums.count() <= MOST_LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        spread = sums.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int"))
        joined = salted.join(spread, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_to"))).drop("_salt", "_to")
    return joined.drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = books.digest() if books else None
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another, every part compared with every entry."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT p.r, p.part, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 16 + c.entry) AS best
  FROM p JOIN c{k} c USING (part) GROUP BY p.r, p.part)""")
        if k < ROUNDS:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT part, entry, list(CASE WHEN s % n < 0 THEN (s - (s % n) - n) // n ELSE (s - s % n) // n END ORDER BY i) AS x FROM (
      SELECT part, (best % 16)::BIGINT AS entry, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL) GROUP BY ALL) m
  ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM kept, range(8) t(part)),
c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 16),{",".join(steps)},
final AS (SELECT r, sum(best // 16) AS error, string_agg(printf('%02x', (best % 16)::BIGINT), '' ORDER BY part) AS code FROM a{ROUNDS} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS})
SELECT k.vec_id, f.code, f.error::BIGINT AS error, (sum(f.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.h AS codebooks_sha256
FROM kept k JOIN final f USING (r), book b
"""


OP11_SQL = _oracle()
