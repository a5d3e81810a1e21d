"""Mixing, sharding and the pipeline."""

import collections
import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing, sharding

SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_mixing_permutation(spark, n):
    moved = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).collect()
    assert sorted(r.x for r in moved) == list(range(n))


def corpus(seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", "Z", "é", None]
    rows = []
    for i in range(n):
        s = sources[min(6, int(rng.expovariate(0.9)))]
        rows.append((i, s, " ".join(["w"] * rng.choice((0, 1, 5, 90, 900)))))
    rows += [(n, "tiny", "one two"), (n + 1, "a", None), (n + 2, "b", "x y"), (n + 2, "b", "x y"), (None, "c", "q r s")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixing.Mix(docs, block=16)
    out = mix.taken.collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute.targets(sizes)
    took = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        took[r.source] += r.taken
    for s, w in want.items():
        assert abs(took[s] - w) <= 3 * 16 + 1e-6, (s, took[s], w)
    again = mixing.Mix(docs.repartition(7).orderBy(F.rand(3)), block=16).taken.collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mix_output_is_gapless(spark):
    mix = mixing.Mix(spark.createDataFrame(corpus(3), SCHEMA), block=16, shard_slots=50)
    slots = [(r.shard, r.slot) for r in mix.slots.collect()]
    assert sorted(slots) == [divmod(i, 50) for i in range(len(slots))]
    assert mix.shard_counts.agg(F.sum("slots")).first()[0] == len(slots)
    assert mix.blocks.count() == len(slots)
    for r in mix.blocks.limit(40).collect():
        assert sum(p.words for p in r.pieces) <= 16


def test_mix_output_holds_the_words(spark):
    rng = random.Random(5)
    rows = [(i, s, " ".join(f"{i}.{k}" for k in range(n))) for i, (s, n) in enumerate([(rng.choice(("a", "b", None)), rng.choice((0, 1, 7, 16, 200))) for _ in range(80)])]
    rows += [(None, "a", "x  y\tz"), (99, "a", "one two"), (99, "a", "one two"), (99, "a", "three four"), (98, None, None)]
    mix = mixing.Mix(spark.createDataFrame(rows, SCHEMA), block=16)
    texts = collections.defaultdict(list)
    for d, _, t in rows:
        texts[d].append((t or "").split())
    took, blocks = collections.Counter(), {}
    for r in mix.blocks.collect():
        at = r.block * 16
        for p in r.pieces:
            words = p.text.split(" ")
            assert p.words == len(words) and max(p.start, r.block * 16) == at
            k = at - p.start
            assert any(words == t[k : k + len(words)] and len(t) == p.size for t in texts[p.doc_id])
            took[(p.doc_id, p.text)] += len(words)
            at += len(words)
        assert blocks.setdefault((r.source_id, r.block), r.pieces) == r.pieces
    assert took[(99, "three four")] + took[(99, "one two")] > 0
    assert sum(took.values()) == sum(r.taken for r in mix.taken.collect())
    assert sorted(map(str, mix.taken.collect())) == sorted(map(str, mix.counted.collect()))


@pytest.mark.parametrize("seed", [4, 5])
def test_mix_equals_plain_version(spark, seed):
    """Multinomial draws, corrections, permutations and packing, redone word by word."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(("a", "a", "b", "c", None)), rng.choice((0, 1, 5, 17, 60))) for i in range(150)] + [(3, "a", 5)] * 3 + [(None, "b", 7), (900, "z", 2)]
    docs = spark.createDataFrame([(d, s, " ".join("w" * n)) for d, s, n in rows], SCHEMA)
    mix = mixing.Mix(docs, block=8, shard_slots=40)
    taken, places = brute.mixture(rows, 8, 40)
    found = collections.Counter()
    for r in mix.taken.collect():
        found[r.doc_id, r.source, r["size"]] += r.taken
    assert +found == +taken
    assert {(r.shard, r.slot): (r.source_id, r.block) for r in mix.slots.collect()} == places


def test_counts_of_a_shard_scatter_as_drawn(spark):
    """Counts of the sources in the output shards have the mean and the spread of multinomial draws."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], " ".join(["w"] * 40)) for i in range(4000)], SCHEMA)
    mix = mixing.Mix(docs, block=8, shard_slots=100, weights=(3, 1))
    share = {r.source_id: r.slots / r.all_slots for r in mix.sources.collect()}
    assert abs(share[0] - 0.75) < 0.01
    counts = [r.n for r in mix.drawn.where("source_id = 0 and shard < 190").collect()]
    assert abs(np.mean(counts) - 75) < 1.5 and 2.5 < np.std(counts) < 6.5


def test_mix_with_a_hot_row_and_a_long_text(spark):
    """One row repeated more often than an array may be long, and one text of 300,000 words."""
    docs = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y z").alias("text"))
    docs = docs.union(spark.range(1).select(F.lit(8).cast("long"), F.lit("b"), F.repeat(F.lit("w "), 300_000)))
    out = mixing.Mix(docs).taken.groupBy("doc_id", "target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert {r.doc_id: r.n for r in out} == {7: 40_000, 8: 1}
    assert all(abs(r.taken - r.target) <= 3 * 64 and r.most <= 3 for r in out)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.Mix(empty).taken.collect() == []
    assert mixing.mix_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "a", "")], SCHEMA)
    assert sorted((r.doc_id, r.taken) for r in mixing.Mix(blank).taken.collect()) == [(1, 0), (2, 0)]
    clash = spark.createDataFrame([(1, "a", "x y z", 9)], SCHEMA + ", size int")
    assert mixing.mix_documents(clash).columns == clash.columns


def test_mix_is_native(spark):
    plan = mixing.Mix(spark.createDataFrame(corpus(1, 20), SCHEMA)).taken._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 3)
    moved = f(np.arange(n))
    assert sorted(moved.tolist()) == list(range(n))
    assert f(moved, back=True).tolist() == list(range(n))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_follow_the_law(spark, shards):
    rng = random.Random(1)
    rows = [(i, "a", "t" * rng.randrange(50)) for i in range(500)] + [(7, "a", "same")] * 30 + [(None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sharding.shard(sharding.shard_keys(docs), shards).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(len(by[s]) for s in range(shards)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(sharding.shard_keys(docs.repartition(5)), shards).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    whole = sharding.shard_documents(docs, shards)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole.where("doc_id is not null").collect()) == sorted((r.doc_id, r.shard, r.slot) for r in out if r.doc_id is not None)


def test_a_hot_row_fills_many_slots(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("doc_id"), F.lit("a").alias("text"))
    out = sharding.shard(sharding.shard_keys(rows), 40).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(out) == 40 and {(r.n, r["last"]) for r in out} == {(1250, 1249)}


def test_shards_equal_a_plain_feistel(spark):
    """Numbers by content, then the network with cycle walking on Python's own integers."""
    rows = [(i, "a", "t" * (i % 50)) for i in range(300)]
    keys = sharding.shard_keys(spark.createDataFrame(rows, SCHEMA))
    n, half = 300, 5
    mask, low = (1 << half) - 1, (1 << 64) - 1
    import hashlib

    keyed = [int.from_bytes(hashlib.blake2b(f"17:{r}".encode(), digest_size=8).digest(), "big") for r in range(6)]

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & low
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & low
        return x ^ (x >> 31)

    def once(x):
        a, b = x >> half, x & mask
        for k in keyed:
            a, b = b, a ^ (mix(b ^ k) & mask)
        return (a << half) | b

    for r in sharding.shard(keys, 7).collect():
        x = once(r.row_number)
        while x >= n:
            x = once(x)
        assert (r.shard, r.slot) == (x % 7, x // 7)


def test_shard_edges(spark):
    assert sharding.shard(sharding.shard_keys(spark.createDataFrame([], SCHEMA)), 40).collect() == []
    one = sharding.shard(sharding.shard_keys(spark.createDataFrame([(1, "a", "é")], SCHEMA)), 40).first()
    assert one["size"] == 18 and one.slot == 0


def test_pipeline_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram join", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality, dedup, clean, mix, shards = (f for _, f in corpus_pipeline.STAGES)

    one = quality(spark, docs, sf).cache()
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and kept
    for d, t in texts.items():
        n, _, _, _, rep = brute.measures(t)
        if n < 20 or 100 * rep > 30 * n:
            assert d not in kept

    two = dedup(spark, one, sf).cache()
    left = {r.doc_id for r in two.collect()}
    assert two.columns == docs.columns
    assert left == {d for d, _, c in brute.similar([(d, texts[d]) for d in sorted(kept)], 5, 80) if c == d}

    three = clean(spark, two, sf).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in three.collect()} == {x[0] for x in brute.contamination([(d, texts[d]) for d in left], items) if not x[5]}

    four = mix(spark, three, sf).cache()
    times = collections.Counter(r.doc_id for r in four.collect())
    rates = {r.doc_id: r.taken / r["size"] for r in mixing.Mix(three).taken.collect()}
    assert four.columns == docs.columns and set(times) <= set(rates)
    assert all(int(rate) <= times[d] <= int(rate) + 1 and times[d] <= 3 for d, rate in rates.items())

    five = shards(spark, four, sf).collect()
    assert len(five) == four.count()
    by = collections.Counter(r.shard for r in five)
    assert max(by.values()) - min(by.get(s, 0) for s in range(40)) <= 1
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, five))


def test_pipeline_edges(spark, tmp_path):
    """Every stage in order over an empty table, and over nulls, empty and long texts, repeated rows and clashing columns."""
    sf = "/root/testdata/sf0.001"
    prose = " ".join(f"the word{i} of" for i in range(40))
    rows = [(1, prose, 5, 0.5), (1, prose, 5, 0.5), (2, None, None, None), (None, prose + " x", 1, None), (3, "", 0, 1.0), (4, "the word of " + " ".join(f"the long{i} and" for i in range(50_000)), 9, 2.0), (5, prose + " and more of it", 6, 3.0)]
    schema = "doc_id long, text string, n_words int, score double, source string, size int, shard int, spans int, kept boolean"
    docs = spark.createDataFrame([(*r, "a", 1, 2, 3, True) for r in rows], schema)
    for some, want in ((docs.limit(0), set()), (docs, {1, 4, None})):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, sf)
            assert some.columns == docs.columns
            some = spark.createDataFrame(some.collect(), schema)
        assert {r.doc_id for r in some.collect()} <= want
        out = corpus_pipeline.STAGES[-1][1](spark, some, sf).collect()
        assert len(out) == some.count()


def test_permutation_with_given_rounds_is_the_same(spark):
    """A run of numbers shares the keys of its rounds, which are not hashed anew for each number."""
    n, key = F.lit(97).cast("long"), F.lit(5)
    df = spark.range(97).withColumn("rounds", mixing.rounds_of(n, key))
    rows = df.select(mixing.permuted(F.col("id"), n, key).alias("a"), mixing.permuted(F.col("id"), n, key, rounds=F.col("rounds")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.b for r in rows} == set(range(97))
