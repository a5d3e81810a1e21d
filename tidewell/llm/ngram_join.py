"""Exact n-gram Jaccard join with token-combination prefixes, and its link components.

A document is its set of distinct word shingles, each a 64-bit token. Tokens have one
global order: level by level of the hash space those of one text only, then rare ones;
frequent tokens of all levels come last. Two sets that are similar enough share, within
prefixes of this order, a rare token, or k frequent tokens of one small group: k grows
with the frequency class, and each group lengthens the prefix by k - 1. A level is counted
only for the sets that the levels before it leave with a prefix too short, so most sets
have a quarter of their tokens counted, and those full of common passages all of them.
A signature also tells how many tokens come before it, and so how large a partner can be
that meets here first; only members whose sizes allow each other meet in the bucket of
equal signatures. These candidates are verified on the texts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.graph import components

from .common import Rolling, WordHashes, cut, encoded, mark, may_be_in, mixed, pieces, release, table

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Ends of the levels, as shares of the hash space.
LEVELS = (0.25, 0.5, 1.0)
#: Most sets that hold a token of each class: rare ones are indexed singly, those above in pairs, beyond that in triples.
CLASS_ROWS = (16, 1024)
#: Groups of frequent tokens of a class for each token of a set; prefixes grow by k - 1 tokens for each.
GROUPS = 0.05
#: Bands whose sets are smaller than this index frequent tokens singly.
LEAST_COMBINED = 12
#: Sizes within a cell differ by less than this factor; in a bucket, members of cells that allow each other meet.
CELL = 1.01
#: 64-bit words of the parity bitmap that bounds the difference of two sets.
BITMAP = 16


def _tokens(words: list[bytes], shingle: int, hashes: WordHashes, rolling: Rolling) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence is one token if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 7)], np.uint64)
    return np.unique(rolling(hashes(words)))


def _kernel(shingle: int):
    return WordHashes(), Rolling(shingle, 0x9E3779B97F4A7C15)


def _band(n: int, percent: int) -> int:
    """Similar sets lie in the same or the next band of sizes."""
    return int(math.log(n) / math.log(100 / (percent - 0.1)))


def _band_size(band: int, percent: int) -> float:
    return (100 / (percent - 0.1)) ** band


def _ends(level: int) -> tuple[int, int]:
    """First token of a level, and of the one after it."""
    low, high = (0, *LEVELS)[level], LEVELS[level]
    return int(low * 2**64), min(int(high * 2**64), 2**64 - 1)


def _level(tokens: np.ndarray, level: int) -> np.ndarray:
    low, high = _ends(level)
    stop = len(tokens) if level + 1 == len(LEVELS) else int(np.searchsorted(tokens, np.uint64(high)))
    return tokens[int(np.searchsorted(tokens, np.uint64(low))) : stop]


def _need(n: int, percent: int) -> int:
    """Tokens of which a similar set of any size shares one: all but those that may differ, and one more."""
    return n - (n * percent + 99) // 100 + 1


def _identity(tokens: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts).view(np.int64)))


def _sets(shingle: int):
    """A row for each document: its set's identity, size, bitmap and its tokens of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = _kernel(shingle)
        for piece in pieces(batches):
            rows, parts, bitmaps = [], [], []
            for body in piece.column("body").to_pylist():
                found = _tokens(body.translate(LOWER).split(), shingle, hashes, rolling)
                rows.append((_identity(found, 0), _identity(found, 1), len(found)))
                parts.append(_level(found, 0))
                spots = np.bincount((mixed(found) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
                bitmaps.append(np.packbits(spots.astype(np.uint8)).view(np.int64))
            bits = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * BITMAP).astype(np.int32)), pa.array(np.concatenate(bitmaps)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), _arrays(parts), bits], ["doc_id", "sid", "sid2", "n", "tokens", "bits"])

    return run


def _later_tokens(shingle: int, level: int):
    """doc_id, identity and the tokens of a later level of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = _kernel(shingle)
        for piece in pieces(batches):
            found = [_tokens(body.translate(LOWER).split(), shingle, hashes, rolling) for body in piece.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([_identity(x, 0) for x in found], pa.int64()), _arrays([_level(x, level) for x in found])], ["doc_id", "sid", "tokens"])

    return run


def _combinations(percent: int):
    """Signatures of the sets that frequent tokens are left to tell apart: k of one group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owners, sizes, before = [], [], [], []
            for node, n, left, frequent in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "left", "frequent")), strict=True):
                ordered, signatures = sorted((x["class"], x["token"]) for x in frequent), {}
                done = _need(n, percent) - left
                for band in (_band(n, percent), _band(n, percent) + 1):
                    size, units, groups = _band_size(band, percent), 0, {}
                    for kind, t in ordered:
                        if units >= left:
                            break
                        k = kind + 1 if size >= LEAST_COMBINED else 1
                        group = groups.setdefault((kind, t % max(1, round(GROUPS * size))), [])
                        signatures.update((xxhash.xxh3_64_intdigest(f"{band} {others} {t}") - (1 << 63), done + units) for others in combinations(group, k - 1))
                        units += len(group) >= k - 1
                        group.append(t)
                out.extend(signatures)
                before.extend(signatures.values())
                owners.extend([node] * len(signatures))
                sizes.extend([n] * len(signatures))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out, owners, sizes, before)], ["signature", "node", "n", "before"])

    return run


def _signatures(classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """signature, node, n and most of the classes of sets that may be similar to another one.

    most is the size of the largest set that may be similar and share none of the tokens
    before. Where a token (or the last one of k) is the first that two sets share, `before`
    tokens of each count as not shared, so the intersection is at most n - before, and the
    sum of both sizes at most (100 + percent) / percent times that. Sets so small that
    none but an equal one is similar have no signatures.
    """
    pair = "array<struct<class:int,token:bigint>>"
    need = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    open_ = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("sid", "node", "n", need.alias("left"), "tokens", F.array().cast(pair).alias("frequent"))
    found = []
    for level in range(len(LEVELS)):
        if level:
            near = may_be_in(docs.where("doc_id is not null and text is not null"), F.col("doc_id"), open_, F.col("node")).where("maybe")
            tokens = encoded(near, "doc_id").mapInArrow(_later_tokens(shingle, level), "doc_id long, sid long, tokens array<long>")
            tokens = tokens.groupBy(F.col("doc_id").alias("node"), "sid").agg(F.first("tokens").alias("tokens"))
            open_ = cut(open_.drop("tokens").join(tokens, ["node", "sid"]))
        each = open_.select("sid", F.explode("tokens").alias("token"))
        # A table of its own: adaptive execution splits a hot token only in a join of two plain shuffles.
        counts = cut(each.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"))
        kind = sum((F.col("rows") > most).cast("int") for most in CLASS_ROWS)
        mine = each.join(counts.select("token", kind.alias("class")), "token").groupBy("sid").agg(F.collect_list(F.struct("class", "token")).alias("shared"))
        held = open_.join(mine, "sid", "left").withColumn("shared", F.coalesce("shared", F.array().cast(pair)))
        rare = F.sort_array(F.transform(F.filter("shared", lambda x: x["class"] == 0), lambda x: x["token"]))
        after = F.greatest(F.col("left") - (F.size("tokens") - F.size("shared")), F.lit(0))
        held = cut(held.select("sid", "node", "n", after.alias("after"), rare.alias("rare"), F.concat("frequent", F.filter("shared", lambda x: x["class"] > 0)).alias("frequent")))
        single = held.select(F.posexplode(F.slice("rare", F.lit(1), F.col("after").cast("int"))).alias("at", "signature"), "node", "n", (need - F.col("after")).alias("done"))
        found.append(single.select("signature", "node", "n", (F.col("done") + F.col("at")).alias("before")))
        left = F.col("after") - F.size("rare")
        open_ = held.where(left > 0).select("sid", "node", "n", left.alias("left"), F.lit(None).cast("array<long>").alias("tokens"), "frequent")
        if not open_.head(1):
            break
    found.append(open_.select("node", "n", "left", "frequent").mapInArrow(_combinations(percent), "signature long, node long, n long, before long"))
    most = F.expr(f"(n - before) * {100 + percent} div {percent} - n")
    return functools.reduce(DataFrame.union, found).select("signature", "node", "n", most.alias("most"))


def _meetings(members: DataFrame, percent: int) -> DataFrame:
    """Rows of two members of a bucket (signature), columns ending in _a and _b, whose cells of sizes allow each other.

    A member meets those of its own size or larger, cell by cell up to the largest size
    that its place in the bucket leaves, so a bucket of sets that share much and yet too
    little costs no more than its members.
    """
    cell = lambda size: F.floor(F.log(size.cast("double")) / math.log(CELL))
    side = lambda s: members.select("signature", *(F.col(x).alias(f"{x}_{s}") for x in members.columns if x != "signature"))
    largest = F.least(F.col("most_a"), F.expr(f"n_a * 100 div {percent}"))
    one = side("a").where("most_a >= n_a").withColumn("_cell", F.explode(F.sequence(cell(F.col("n_a")), cell(largest))))
    return one.join(side("b").withColumn("_cell", cell(F.col("n_b"))), ["signature", "_cell"]).drop("_cell")


def _verified(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rolling = _kernel(shingle)
        for piece in pieces(pieces(batches, "body"), "other"):
            keep, last, left = [], None, None
            for node, one, two in zip(*(piece.column(c).to_pylist() for c in ("a", "body", "other")), strict=True):
                if node != last:
                    last, left = node, _tokens(one.translate(LOWER).split(), shingle, hashes, rolling)
                right = _tokens(two.translate(LOWER).split(), shingle, hashes, rolling)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield piece.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def similar_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the documents whose shingle sets are alike.

    members: doc_id, n (set size), class_id (smallest doc_id with the same set) and
    component_id (smallest doc_id reachable by links), a row for each input row.
    links: verified pairs (a, b) of class ids; they connect all that is connected,
    but pairs that the links found before already connect are not listed.

    docs needs doc_id (integer) and text. Words are separated by ASCII white space,
    A-Z lower-cased. Two sets link when 100 * intersection >= percent * union. Null or
    empty text gives an empty set, linked with nothing. Rows with a null doc_id get null
    ids. Repeated rows are in one class; rows that share a doc_id and differ in text
    connect through it. An empty table gives empty results.

    Candidates come in two rounds. First every member of a bucket meets one of it only, which is linear in the bucket and ties groups of copies together. Then
    members of different components of a bucket meet, if their sizes allow each other and
    parity bitmaps leave similarity possible.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    sets = cut(encoded(docs, "doc_id").mapInArrow(_sets(shingle), "doc_id long, sid long, sid2 long, n long, tokens array<long>, bits array<long>"))
    known = sets.where("doc_id is not null and n > 0")
    classes = cut(known.groupBy("sid", "sid2").agg(F.min("doc_id").alias("node"), *(F.first(x).alias(x) for x in ("n", "bits", "tokens"))))
    since = mark()
    signatures = _signatures(classes, docs, shingle, percent)
    smaller = lambda x: F.when(F.col("most") >= F.col("n"), x)
    buckets = signatures.groupBy("signature").agg(F.min("node").alias("_x"), F.max("node").alias("_y"), F.min(smaller(F.struct("node", "n", "most"))).alias("hub"), F.min(smaller(F.col("n"))).alias("near"), F.max(smaller(F.col("most"))).alias("far"))
    buckets = buckets.where("_x < _y and hub is not null").drop("_x", "_y")
    signatures = cut(signatures.join(buckets, "signature").where("most >= n or n between near and far").drop("near", "far"))
    release(spark, since, keep=1)

    ends = F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")
    stars = signatures.where("node <> hub.node and n <= hub.most and hub.n <= most").select(*ends).distinct()
    links = cut(_checked(stars, classes, docs, shingle, percent))
    # Rows of one doc_id with different texts are one node of the graph.
    several = known.select("doc_id", "sid", "sid2").distinct().join(classes, ["sid", "sid2"]).where("doc_id <> node").groupBy("doc_id", "node").count()
    twice = known.select("doc_id", "sid", "sid2").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    joined = several.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = cut(components(links.union(joined)))

    labelled = signatures.select("signature", "node", "n", "most").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_buckets = labelled.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("signature")
    rest = labelled.join(mixed_buckets, "signature").join(classes.select("node", "bits"), "node")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    possible = (
        (F.col("component_a") != F.col("component_b")) & F.expr("n_a < n_b or n_a = n_b and node_a < node_b")
        & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
        & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    )
    cross = _meetings(rest, percent).where(possible).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more = cut(_checked(cross, classes, docs, shingle, percent, bounded=True))
    links = links.union(more)
    if more.head(1):
        found = cut(components(links.union(joined)))

    named = sets.join(classes.select("sid", "sid2", "node"), ["sid", "sid2"], "left").join(found, "node", "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    members = named.select("doc_id", "n", own(F.when(F.col("n") > 0, F.col("node"))).alias("class_id"), own(F.when(F.col("n") > 0, F.coalesce("component", "node"))).alias("component_id"))
    return members, links


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) of class ids whose texts are similar enough."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"), F.col("sid").alias(f"sid_{s}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    if not bounded:
        differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
        sized = sized.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))))
    sized = cut(sized.select("a", "b"))
    ends = sized.select(F.col("a").alias("end")).union(sized.select("b")).distinct()
    texts = may_be_in(docs.where("doc_id is not null and text is not null"), F.col("doc_id"), ends, F.col("end")).where("maybe")
    texts = encoded(texts, "doc_id")
    first = sized.join(texts.withColumnRenamed("doc_id", "a"), "a")
    both = first.join(texts.select(F.col("doc_id").alias("b"), F.col("body").alias("other")), "b").select("a", "b", "body", "other")
    return both.mapInArrow(_verified(shingle, percent), "a long, b long").distinct()


def first_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of similar documents: the one with the smallest doc_id.

    Rows with a null doc_id and documents with empty sets stay. Of rows that repeat a
    kept doc_id all stay, as they are one document.
    """
    members, _ = similar_classes(docs, shingle, percent)
    gone = cut(members.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    whole = docs.select(F.struct("*").alias("_whole"), F.col("doc_id").cast("long").alias("_id"))
    marked = may_be_in(whole, F.col("_id"), gone, F.col("_gone"), name="_maybe")
    checked = marked.where("_maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return marked.where("not _maybe").unionByName(checked).select("_whole.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = similar_classes(table(spark, sf_dir, "documents"), 4, 85)
    return members.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS k
  FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
ks AS (SELECT doc_id, md5(string_agg(k, '' ORDER BY k)) AS h FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.m AS component_id,
  CASE WHEN ks.h IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY ks.h) END AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN ks USING (doc_id)
JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
