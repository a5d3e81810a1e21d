"""Benchmark decontamination over suffix arrays of the training shards.

Each task builds a word-level suffix array of its shard of documents and
binary-searches in it every test suffix that is long enough to count, by its first
words; the ranges found are all verbatim occurrences. Suffixes of the documents that
begin there and test suffixes are then ranked together by prefix doubling, and the
nearest test suffix gives the longest match at each place, with its location.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, table

#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: UTF-8 bytes of test texts that one pass broadcasts; a larger benchmark is searched in several passes.
BLOCK_BYTES = 8 << 20
#: Passes after which the documents are written, so that plans stay short.
PASSES = 8
SPANS = "array<struct<item_id:bigint,doc_start:int,item_start:int,length:int>>"


class TestSuffixes:
    """The search keys of a block of test items, and which items own them.

    Of suffixes only the first `window` words are keys; equal ones are one key, and a suffix
    with fewer words left holds no match unless it is a whole item.
    """

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        words = [(i, x.translate(FOLD).split()) for i, x in items]
        words = [(i, x) for i, x in words if x]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}), 1)}
        self.window, self.bits = window, max(1, len(self.ids).bit_length())
        self.per_key = max(1, 63 // self.bits)
        known: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        at_window, at_item, at_place = [], [], []
        for item, ws in words:
            ids = tuple(self.ids[w] for w in ws)
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                k = known.setdefault(ids[at : at + size], len(owners))
                if k == len(owners):
                    owners.append(set())
                owners[k].add(item)
                at_window.append(k)
                at_item.append(item)
                at_place.append(at)
        self.suffixes = list(known)
        # All places of test windows in their texts, and the distinct items of each window, one after the other.
        self.at_window, self.at_item, self.at_place = (np.array(x, np.int64) for x in (at_window, at_item, at_place))
        self.owner_ends = np.cumsum([0, *map(len, owners)])
        self.owners = np.array([i for x in owners for i in sorted(x)], np.int64)
        self.lengths = np.array([len(s) for s in self.suffixes], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        low, high = (np.full((len(self.suffixes), window), fill, np.int64) for fill in (0, (1 << self.bits) - 1))
        for k, s in enumerate(self.suffixes):
            low[k, : len(s)] = high[k, : len(s)] = s
        self.low, self.high = self.packed(low.T), self.packed(high.T)

    def packed(self, columns) -> np.ndarray:
        """Several words to one 63-bit key, in their order; a row for each key."""
        keys = []
        for k in range(0, self.window, self.per_key):
            key = np.zeros(len(columns[0]), np.int64)
            for c in columns[k : k + self.per_key]:
                key = (key << self.bits) | c
            keys.append(key)
        return np.array(keys)


def _bisect(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted key the first place in the sorted keys not before it, or after it."""
    low, high = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], keys.shape[1], np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, keys.shape[1] - 1)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for k, w in zip(keys, wanted, strict=True):
            x = k[middle]
            less |= equal & (x < w)
            equal &= x == w
        right = open_ & ((less | equal) if after else less)
        low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
    return low


def _occurrences(tokens: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, place in the shard) of all verbatim occurrences; token 0 is no test word."""
    outside = np.flatnonzero(tokens == 0)
    until = outside[np.searchsorted(outside, np.arange(len(tokens)))] - np.arange(len(tokens))
    places = np.flatnonzero(until >= test.shortest)  # other suffixes can't start with a whole test window
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = test.packed([np.where(until[places] > k, tokens[np.minimum(places + k, len(tokens) - 1)], 0) for k in range(test.window)])
    order = np.lexsort(keys[::-1])
    suffix_array, keys = places[order], keys[:, order]
    first, end = _bisect(keys, test.low, False), _bisect(keys, test.high, True)
    found = np.flatnonzero(end > first)
    counts = (end - first)[found]
    which = np.repeat(found, counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return which, suffix_array[first[which] + offset]


def _ranked(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... symbols from each place to the end of its run, until runs are whole."""
    ranks, length, here = [np.unique(symbols, return_inverse=True)[1]], 1, np.arange(len(symbols))
    longest = int((ends - here).max())
    while length < longest:
        inside = here + length < ends
        after = np.where(inside, ranks[-1][np.minimum(here + length, len(symbols) - 1)] + 1, 0)
        ranks.append(np.unique(ranks[-1] * (len(symbols) + 2) + after, return_inverse=True)[1])
        length *= 2
    return ranks


def _common(ranks: list[np.ndarray], ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the runs from the places in `one` and `two`."""
    most, found = np.minimum(ends[one] - one, ends[two] - two), np.zeros(len(one), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        fits = found + step <= most
        a, b = np.where(fits, one + found, 0), np.where(fits, two + found, 0)
        found += step * (fits & (ranks[k][a] == ranks[k][b]))
    return found


def _runs(places: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """End, as an index, of the run of consecutive places that each one lies in."""
    breaks = np.flatnonzero((np.diff(places) != 1) | apart[1:]) + 1
    stops = np.r_[breaks, len(places)]
    return stops[np.searchsorted(breaks, np.arange(len(places)), "right")]


def _longest(which: np.ndarray, places: np.ndarray, docs: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, words, item, place in the item) of the maximal matches; a place begins at most one.

    Whole windows only; docs keeps runs of neighbouring documents apart.
    """
    order = np.argsort(places, kind="stable")
    which, places, docs = which[order], places[order], docs[order]
    relevant = np.zeros(len(test.suffixes), bool)
    relevant[which] = True
    held = np.flatnonzero(relevant[test.at_window])
    ends = np.r_[_runs(places, np.r_[False, np.diff(docs) != 0]), len(which) + _runs(held, np.r_[False, (np.diff(test.at_item[held]) != 0) | (np.diff(test.at_place[held]) != 1)])]
    ranks = _ranked(np.r_[which, test.at_window[held]], ends)
    order = np.argsort(ranks[-1], kind="stable")
    is_test, at = order >= len(which), np.arange(len(order))
    before = np.maximum.accumulate(np.where(is_test, at, -1))
    after = np.minimum.accumulate(np.where(is_test, at, len(order))[::-1])[::-1]
    best, words = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
    for near, exists in ((before, before >= 0), (after, after < len(order))):
        mine = np.flatnonzero(exists & ~is_test)
        one, two = order[mine], order[near[mine]]
        common = _common(ranks, ends, one, two)
        better = common > words[one]
        words[one[better]], best[one[better]] = common[better], two[better]
    within = np.r_[False, (np.diff(places) == 1) & (np.diff(docs) == 0) & (words[:-1] > words[1:])]
    kept = np.flatnonzero(~within)
    source = held[best[kept] - len(which)]
    return places[kept], words[kept] + test.window - 1, test.at_item[source], test.at_place[source]


def _matches(which: np.ndarray, places: np.ndarray, docs: np.ndarray, test: TestSuffixes) -> list[np.ndarray]:
    """Place, words, item and place in the item of all maximal matches, short items whole."""
    long = test.lengths[which] == test.window
    parts = [_longest(which[long], places[long], docs[long], test)] if long.any() else []
    if not long.all():
        short = which[~long]
        parts.append((places[~long], test.lengths[short], test.owners[test.owner_ends[short]], np.zeros(len(short), np.int64)))
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _search(held, keep_body: bool, flag_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestSuffixes = held.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
        for piece in pieces(batches):
            lengths, parts = [], []
            for body in piece.column("body").to_pylist():
                words = body.translate(FOLD).split()
                lengths.append(len(words))
                parts.append(np.fromiter((test.ids.get(w, 0) for w in words), np.int64, len(words)))
                parts.append(np.zeros(1, np.int64))  # no match reaches into the next document
            starts = np.cumsum([0, *(n + 1 for n in lengths)])
            hit = np.zeros(len(lengths), bool)
            spans: dict[int, list[dict]] = {}
            items: dict[int, np.ndarray] = {}
            if test.suffixes:
                which, places = _occurrences(np.concatenate(parts), test)
                docs = np.searchsorted(starts, places, "right") - 1
                hit[docs] = True
                if len(which) and not flag_only:
                    place, words, item, at = _matches(which, places, docs, test)
                    owner = np.searchsorted(starts, place, "right") - 1
                    for d, p, n, i, a in zip(owner.tolist(), (place - starts[owner]).tolist(), words.tolist(), item.tolist(), at.tolist(), strict=True):
                        spans.setdefault(d, []).append({"item_id": i, "doc_start": p, "item_start": a, "length": n})
                    pairs = np.unique(docs * len(test.suffixes) + which)
                    for d in np.unique(docs).tolist():
                        mine = pairs[np.searchsorted(pairs, d * len(test.suffixes)) : np.searchsorted(pairs, (d + 1) * len(test.suffixes))] % len(test.suffixes)
                        items[d] = np.unique(np.concatenate([test.owners[test.owner_ends[w] : test.owner_ends[w + 1]] for w in mine.tolist()]))
            columns = {"row": piece.column("row"), "hit": pa.array(hit | piece.column("hit").to_numpy(zero_copy_only=False))}
            if not flag_only:
                had, named = piece.column("spans").to_pylist(), piece.column("items").to_pylist()
                columns["n_words"] = pa.array(lengths, pa.int64())
                columns["spans"] = pa.array([(a or []) + spans.get(d, []) for d, a in enumerate(had)], kind)
                columns["items"] = pa.array([np.union1d(a or [], items[d]).astype(np.int64) if d in items else (a or []) for d, a in enumerate(named)], pa.list_(pa.int64()))
            if keep_body:
                columns["body"] = piece.column("body")
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _passes(docs: DataFrame, tests: DataFrame, window: int, keep: list[str], flag_only: bool) -> DataFrame:
    """row (the columns to keep), hit and, unless flag_only, n_words, spans and items of each document."""
    spark = docs.sparkSession
    items = tests.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("body"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) * 5 // (4 * BLOCK_BYTES)))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    found = [F.lit(False).alias("hit")] + ([] if flag_only else [F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<bigint>").alias("items")])
    df = docs.select(row, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"), *found)
    kind = f"row {df.schema['row'].dataType.simpleString()}, hit boolean" + ("" if flag_only else f", n_words long, spans {SPANS}, items array<bigint>")
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block).collect()
        held = spark.sparkContext.broadcast(TestSuffixes([(r[0], bytes(r[1])) for r in part], window))
        more = block + 1 < blocks
        df = df.mapInArrow(_search(held, more, flag_only), kind + ", body binary" * more)
        if more and block % PASSES == PASSES - 1:
            df = cut(df)
    return df


def find_matches(docs: DataFrame, tests: DataFrame, window: int = 10, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words (long), spans (the maximal verbatim matches with test items) and items (all that match).

    docs needs text, tests item_id (integer) and text; the columns `keep` of docs are
    kept, or all (n_words, spans and items are replaced where they exist). A span is (item_id,
    doc_start, item_start, length) in words, at least `window` words long, or the whole of a
    shorter item: the longest match from doc_start on with any test text, of which one place
    is named, and not the end of a match that begins before. So a text repeated in many items or
    places has as many spans as it has places in the document, not their product. Words are
    runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

    Null or empty text has no words and no spans; items without words or with a null
    item_id match nothing; repeated items and rows are each judged; empty tables give
    empty spans or no rows; an item_id that is no integer is an error. The tests are broadcast
    in blocks of at most BLOCK_BYTES (or one item), a pass over the documents each, without a shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "spans", "items")]
    return _passes(docs, tests, window, keep, False).select("row.*", "n_words", "spans", "items")


def judged(matches: DataFrame) -> DataFrame:
    """matches with n_hit (document words in any span) and contaminated."""
    covered = F.aggregate(
        F.array_sort(F.transform("spans", lambda s: F.struct(s["doc_start"].alias("a"), (s["doc_start"] + s["length"]).alias("b")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    return matches.withColumn("n_hit", covered).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, tests: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any test window, with their columns as they were."""
    thin = docs.select(F.struct("*").alias("whole"), "text")
    return _passes(thin, tests, window, ["whole"], True).where("not hit").select("row.whole.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    longest = F.coalesce(F.array_max(F.transform("spans", lambda s: s["length"])), F.lit(0))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated", longest.cast("long").alias("longest_match"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (
  SELECT item_id, o, least(10, len(ws)) AS l, array_to_string(ws[o:o + least(10, len(ws)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(o) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, i, l, array_to_string(ws[i:i + l - 1], ' ') AS k
  FROM d, sizes, unnest(range(1, len(ws) - l + 2)) AS r(i) WHERE len(ws) >= l),
hit AS (SELECT DISTINCT doc_id, item_id, i, o, l FROM dw JOIN bw USING (l, k)),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, l)) AS u(j) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
run AS (
  SELECT doc_id, item_id, i, l, i - o AS g, i - row_number() OVER (PARTITION BY doc_id, item_id, i - o ORDER BY i) AS isl FROM hit),
lng AS (
  SELECT doc_id, max(m) AS m FROM (SELECT doc_id, max(i + l) - min(i) AS m FROM run GROUP BY doc_id, item_id, g, isl) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(m, 0) AS longest_match
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN lng USING (doc_id)
"""
