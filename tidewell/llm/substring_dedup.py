"""Exact substring deduplication over anchors at difference-cover positions.

Any two equal runs of 50 words, wherever they start, hold an aligned pair of
20-word anchors: the cover positions modulo 31 are a perfect difference set, so
for every pair of starts some shift below 31 puts both on cover positions. Only
those 6 in 31 positions are hashed and shuffled. Around anchors that two
different texts share, the full 50-word windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, cut, encoded, may_be_in, pieces, table

#: A perfect difference set: every residue modulo 31 is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _text_hash(words: list[bytes], seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed) - (1 << 63)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchors(window: int):
    """A row for each document: t and u, 128 bits that stand for its word sequence, its length and its anchors in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = WordHashes(), Rolling(window - PERIOD + 1, BASES[0])
        cover = np.isin(np.arange(PERIOD), COVER)
        for piece in pieces(batches):
            texts, others, sizes, parts = [], [], [], []
            for body in piece.column("body").to_pylist():
                words = body.split()
                found = rolling(hashes(words)) if len(words) >= window else np.empty(0, np.uint64)
                texts.append(_text_hash(words))
                others.append(_text_hash(words, 1))
                sizes.append(len(words))
                parts.append(found[np.flatnonzero(cover[np.arange(len(found)) % PERIOD])])
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            anchors = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(parts))))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, pa.int64()) for x in (texts, others, sizes)), anchors], ["doc_id", "t", "u", "n_words", "anchors"])

    return run


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("body"), pa.array((_text_hash(x.split()) for x in piece.column("body").to_pylist()), pa.int64())], ["doc_id", "body", "t"])


def _windows(window: int):
    """128-bit hashes of the windows that hold an anchor at one of a text's positions; place is the text's number under its doc_id and the position, in 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(), WordHashes(1)
        rolling = [Rolling(window, b) for b in BASES]
        reach = PERIOD - 1
        for piece in pieces(batches):
            parts = []
            for doc_id, nth, body, spots in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "nth", "body", "spots")), strict=True):
                words = body.split()
                n = len(words) - window + 1
                if n <= 0:
                    continue
                edge = np.zeros(n + 1, np.int32)
                spots = np.asarray(spots)  # numbers of anchors, whose positions follow from the cover
                spots = spots // len(COVER) * PERIOD + np.asarray(COVER)[spots % len(COVER)]
                np.add.at(edge, np.maximum(spots - reach, 0), 1)
                np.add.at(edge, np.minimum(spots + 1, n), -1)
                at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                one, two = (_signed(r(h(words))[at]) for r, h in zip(rolling, hashes, strict=True))
                parts.append((one, two, np.full(len(at), doc_id), (nth << 32) + at))
            if parts:
                a, b, d, p = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d), pa.array(p.astype(np.int64))], ["w1", "w2", "doc_id", "place"])

    return run


def _cleaned(window: int):
    """Result rows; `copy` documents lose all words, others the windows at `starts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for doc_id, body, copy, starts in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "body", "copy", "starts")), strict=True):
                words = body.split()
                n = len(words)
                if copy and n >= window:
                    words = []
                elif starts:
                    edge = np.zeros(n + 1, np.int32)
                    starts = np.asarray(starts)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    words = [w for w, k in zip(words, np.cumsum(edge[:n]), strict=True) if not k]
                text = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(text).hexdigest(), text.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Every document with the words left that no smaller document's window covers.

    docs needs doc_id (integer) and text; further columns are ignored. A window is
    `window` consecutive words of one document. A word goes if a window over it also
    starts in a document with a smaller doc_id; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256, kept_text, a row for each input row.

    Null or empty text has no words: 0, 0, the hash of no bytes, empty text. Rows with
    a null doc_id neither lose words nor take them from others. Rows that share one
    doc_id do not take words from each other. An empty table gives an empty result.

    Word sequences and windows are known by 128-bit hashes. Groups of copies meet in
    partial aggregations only. Owners of anchors, texts and windows are tables of their
    own: adaptive execution splits a hot key only in a join of two plain shuffles.
    """
    docs = docs.select("doc_id", "text")
    known = encoded(docs.where("doc_id is not null"), F.col("doc_id").cast("long").alias("doc_id"))
    hashed = cut(known.mapInArrow(_anchors(window), "doc_id long, t long, u long, n_words long, anchors array<long>").where(F.col("n_words") >= window))
    thin = hashed.select("doc_id", "t", "u").distinct()
    first = cut(thin.groupBy("t", "u").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    anchors = hashed.select("doc_id", "t", "u", F.posexplode("anchors").alias("k", "anchor"))
    own = F.xxhash64("t", "u", "anchor")
    shared = cut(anchors.groupBy("anchor").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a < b").select("anchor"))
    spots = anchors.select("doc_id", "t", "k", "anchor").join(shared, "anchor").groupBy("doc_id", "t").agg(F.collect_set("k").alias("spots"))
    firsts = first.select(F.col("first").alias("doc_id"), "t").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("t")).cast("long") - 1
    spots = cut(spots.join(firsts, ["doc_id", "t"], "left_semi").withColumn("nth", nth))

    near = may_be_in(known, F.col("doc_id"), spots, F.col("doc_id")).where("maybe").drop("maybe")
    near = near.mapInArrow(_with_hash, "doc_id long, body binary, t long").join(spots, ["doc_id", "t"])
    windows = cut(near.select("doc_id", "nth", "body", "spots").mapInArrow(_windows(window), "w1 long, w2 long, doc_id long, place long"))
    owners = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("w1", "w2", "owner"))
    starts = windows.join(owners, ["w1", "w2"]).where("owner < doc_id").groupBy("doc_id", F.shiftright("place", 32).alias("nth"))
    starts = starts.agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("starts"))

    own = spots.select("doc_id", "t", "nth").join(starts, ["doc_id", "nth"]).select("doc_id", "t", "starts", F.lit(False).alias("copy"))
    copies = thin.join(first.where("first < last"), ["t", "u"]).where("first < doc_id").select("doc_id", "t", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    losses = cut(own.unionByName(copies))

    marked = may_be_in(encoded(docs, F.col("doc_id").cast("long").alias("doc_id")), F.col("doc_id"), losses, F.col("doc_id"))
    hit = marked.where("maybe and doc_id is not null").select("doc_id", "body").mapInArrow(_with_hash, "doc_id long, body binary, t long")
    hit = hit.join(losses, ["doc_id", "t"], "left").select("doc_id", "body", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    clear = marked.where("not maybe or doc_id is null").select("doc_id", "body", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    return clear.unionByName(hit).mapInArrow(_cleaned(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The contract in SQL: every 50-word window by its start, its smallest document, the words covered.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
n AS (
  SELECT doc_id, ws, len(ws) AS n FROM w),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM n, unnest(range(1, n - 48)) AS r(i) WHERE n >= 50),
own AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k),
hit AS (SELECT doc_id, list(i) AS st FROM win JOIN own USING (k) WHERE o < doc_id GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, s + d AS i FROM hit, unnest(st) AS u(s), unnest(range(0, 50)) AS v(d)),
gl AS (SELECT doc_id, count(*) AS g FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS txt
  FROM (SELECT n.doc_id, i, ws[i] AS x FROM n JOIN gl USING (doc_id), unnest(range(1, n + 1)) AS r(i)) a
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT n.doc_id, n AS n_words, coalesce(g, 0) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(txt, '') END) AS kept_sha256
FROM n LEFT JOIN gl USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
