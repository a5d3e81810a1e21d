"""Exact similarity search over vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markup import spread

c = F.col

#: Queries and points of one block of products, which stays in a core's cache.
QUERIES_AT_ONCE, POINTS_AT_ONCE = 128, 256
#: Candidates that a task holds before it keeps the best of them only, or gives away what it holds.
MOST_HELD = 500_000
#: Components beyond it could overflow in a product; such vectors go by column functions.
LARGEST = 1e60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with a small guard, so that zero vectors score 0."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def similarities(points: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), most_queries: int = 10_000) -> DataFrame:
    """query, key, the columns to keep and sim of every point with every query.

    Points are never moved: a stated set of queries, counted before it is broadcast, meets
    every point once. More queries than most_queries go in blocks by hash.
    """
    pts = points.select(key, *keep, c(vector).alias("_v"), norm(c(vector)).alias("_n"))
    qs = queries.select(c(key).alias("query"), c(vector).alias("_q"), norm(c(vector)).alias("_m"))
    blocks = max(1, -(-qs.count() // most_queries))
    found = None
    for b in range(blocks):
        part = qs if blocks == 1 else qs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        sims = pts.crossJoin(F.broadcast(part)).select("query", key, *keep, (dot(c("_v"), c("_q")) / (c("_n") * c("_m") + 1e-12)).alias("sim"))
        found = sims if found is None else found.unionByName(sims)
    return found


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as a matrix of doubles, and their norms summed in the order of `dot`."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.ascontiguousarray(flat.reshape(len(vectors), -1).T)
    total = np.zeros(x.shape[1])
    for row in x:
        total += row * row
    return x, np.sqrt(total)


def _products(q: np.ndarray, m: np.ndarray, x: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks of similarities of queries (rows) with points; products are added in the order of `dot`, so they equal it to the last bit."""
    for p in range(0, x.shape[1], POINTS_AT_ONCE):
        points = slice(p, min(p + POINTS_AT_ONCE, x.shape[1]))
        for k in range(0, q.shape[1], QUERIES_AT_ONCE):
            some = slice(k, min(k + QUERIES_AT_ONCE, q.shape[1]))
            total = np.zeros((some.stop - some.start, points.stop - points.start))
            one = np.empty_like(total)
            for a, b in zip(q[:, some], x[:, points], strict=True):
                np.multiply(a[:, None], b[None, :], out=one)
                total += one
            yield some, points, total / (m[some][:, None] * n[points][None, :] + 1e-12)


class _Best:
    """Candidates for the k best points of each query among those seen.

    Places go by rounded similarities, which Spark takes; so a candidate goes only when
    it is below the k-th by more than rounding can mend, or has k equals of smaller keys.
    """

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, at: slice, keys: np.ndarray, sims: np.ndarray) -> None:
        q, p = np.nonzero(sims >= (self.least[at] - 2e-9)[:, None])
        if len(q):
            self.parts.append((q + at.start, keys[p], sims[q, p]))
            self.n += len(q)

    def shrink(self) -> None:
        q, keys, sims = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((keys, -sims, q))
        q, keys, sims = q[order], keys[order], sims[order]
        new = np.r_[True, q[1:] != q[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(q)])
        full = sizes >= self.k
        self.least[q[starts[full]]] = np.maximum(self.least[q[starts[full]]], sims[starts[full] + self.k - 1])
        runs = np.flatnonzero(new | np.r_[True, sims[1:] != sims[:-1]])
        equals = np.arange(len(q)) - np.repeat(runs, np.diff(np.r_[runs, len(q)]))
        held = (sims >= self.least[q] - 2e-9) & (equals < self.k)
        self.parts, self.n = [(q[held], keys[held], sims[held])], int(held.sum())

    def given(self) -> tuple | None:
        parts, self.parts, self.n = self.parts, [], 0
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else None


def _met(points: DataFrame, queries: DataFrame, key: str, vector: str, keep: tuple[str, ...], most_queries: int, schema: Callable, task: Callable, rest: Callable) -> DataFrame:
    """Results of task(query ids, q, m, batches) over the points for each block of queries, and rest(similarities) of the vectors that are no plain ones.

    Plain vectors have the length of the queries' longest and finite components. A stated
    set of queries, counted first, is sent to the tasks in blocks of most_queries.
    """
    spark = points.sparkSession
    qs = queries.select(key, vector)
    count, width = qs.agg(F.count("*"), F.max(F.size(vector))).first()
    plain = c(key).isNotNull() & (F.size(vector) == F.lit(width or 0)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    plain = F.coalesce(plain, F.lit(False)) & F.lit((width or 0) > 0)
    pts = spread(points.where(plain).select(key, c(vector).alias("_v"), *keep), key)
    parts = [rest(similarities(points.where(~plain), qs, key, vector, keep, most_queries)), rest(similarities(points.where(plain), qs.where(~plain), key, vector, keep, most_queries))]
    blocks = max(1, -(-count // most_queries))
    for b in range(blocks):
        part = qs.where(plain) if blocks == 1 else qs.where(plain & (F.pmod(F.xxhash64(key), F.lit(blocks)) == b))
        held = part.toArrow()
        if not held.num_rows:
            continue
        ids = held.column(0).combine_chunks()
        sent = spark.sparkContext.broadcast((ids, *_matrix(held.column(1).combine_chunks())))
        parts.append(pts.mapInArrow(lambda batches, sent=sent: task(*sent.value, batches), schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _candidates(points: DataFrame, queries: DataFrame, k: int, key: str, vector: str, most_queries: int) -> DataFrame:
    """query, key and sim of some points of each query, among them its k best."""

    def task(ids: pa.Array, q: np.ndarray, m: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)

        def out() -> Iterator[pa.RecordBatch]:
            if (given := best.given()) is not None:
                at, keys, sims = given
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(keys, ids.type), pa.array(sims, pa.float64())], ["query", key, "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, ps, sims in _products(q, m, *_matrix(batch.column(1))):
                best.add(at, keys[ps], sims)
                if best.n > MOST_HELD + 2 * k * len(ids):
                    best.shrink()
                    if best.n > MOST_HELD + k * len(ids):
                        yield from out()
        if best.n:
            best.shrink()
        yield from out()

    kind = points.schema[key].dataType.simpleString()
    return _met(points, queries, key, vector, (), most_queries, f"query {kind}, {key} {kind}, sim double", task, lambda df: df)


def best_by(points: DataFrame, queries: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """query, `by` and sim: the greatest similarity of each query with the points of each value of `by`."""

    def task(ids: pa.Array, q: np.ndarray, m: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for value, sims in best.items():
                some = np.flatnonzero(sims > -np.inf)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array([value] * len(some), kind_of), pa.array(sims[some], pa.float64())], ["query", by, "sim"])
            best.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).dictionary_encode(null_encoding="encode")
            kind_of, values, codes = coded.type.value_type, coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for at, ps, sims in _products(q, m, *_matrix(batch.column(1))):
                order = np.argsort(codes[ps], kind="stable")
                starts = np.flatnonzero(np.diff(codes[ps][order], prepend=-1))
                for code, top in zip(codes[ps][order][starts], np.maximum.reduceat(sims[:, order], starts, axis=1).T, strict=True):
                    mine = best.setdefault(values[code], np.full(len(ids), -np.inf))
                    np.maximum(mine[at], top, out=mine[at])
                if len(best) * len(ids) > 8 * MOST_HELD:
                    yield from out()
        yield from out()

    kinds = {x: points.schema[x].dataType.simpleString() for x in (key, by)}
    found = _met(points, queries, key, vector, (by,), most_queries, f"query {kinds[key]}, {by} {kinds[by]}, sim double", task, lambda df: df.select("query", by, "sim"))
    return found.groupBy("query", by).agg(F.max("sim").alias("sim"))


def search(points: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, most_queries: int = 10_000) -> DataFrame:
    """query, key, sim and place of the k best points of each query, smaller keys first on ties.

    Each task keeps its candidates for the k best of a query, and those come together by
    query (under the optimiser's group limit, asserted in the tests).
    """
    found = _candidates(points if where is None else points.where(where), queries, k, key, vector, most_queries)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), key))
    return found.withColumn("place", place).where(c("place") <= k)
