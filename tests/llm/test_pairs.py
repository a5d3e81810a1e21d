"""Operators that compare documents: decontamination, n-gram join, substring deduplication."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed):
    """Texts, exact copies, and copies with a few words changed, around the threshold; ids out of order."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = words(rng, rng.choice((3, 4, 20, 60, 150)))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(copy)
    common = words(rng, 30)
    texts += [common + words(rng, 10) for _ in range(20)] + [common + words(rng, 2) for _ in range(20)]
    texts = [" ".join(t) for t in texts] + [None, "", " \n ", "One two THREE four", "one TWO three four", "one"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "shingle", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 3, 60)])
def test_join_equals_brute_force(spark, seed, shingle, percent):
    docs = near_copies(seed)
    members, links = ngram_join.similar_classes(spark.createDataFrame(docs, SCHEMA), shingle, percent)
    found = {(r.doc_id, r.n, r.component_id) for r in members.collect()}
    assert found == set(brute.similar(docs, shingle, percent))
    sets = {d: brute.shingles(t, shingle) for d, t in docs}
    assert all(100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a, b in links.collect())


def test_join_with_frequent_tokens(spark):
    """Tokens in more sets than the rare ones are indexed in combinations; no link is lost by it."""
    rng = random.Random(9)
    common = words(rng, 120, 10**6)
    docs = []
    for i in range(60):
        text = list(common)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(len(text))] = f"y{i}-{rng.randrange(99)}"
        docs.append((i, " ".join(text)))
    members, _ = ngram_join.similar_classes(spark.createDataFrame(docs, SCHEMA), 4, 85)
    assert {(r.doc_id, r.n, r.component_id) for r in members.collect()} == set(brute.similar(docs, 4, 85))


@pytest.mark.parametrize(("rows", "percent"), [((1, 3), 85), ((2, 6), 80), ((0, 0), 85), ((1, 1), 70)])
def test_join_with_many_classes_of_tokens(spark, monkeypatch, rows, percent):
    """Small bounds of the classes bring pairs and triples, and all levels, into play; headers are hot."""
    monkeypatch.setattr(ngram_join, "CLASS_ROWS", rows)
    rng = random.Random(percent + rows[0])
    head, docs = words(rng, 30, 10**6), []
    for _ in range(9):
        base = words(rng, rng.choice((5, 8, 14, 40, 160)), 10**6)
        base = head[: rng.choice((0, len(base), 3 * len(base)))] + base
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    members, _ = ngram_join.similar_classes(spark.createDataFrame(docs, SCHEMA), 3, percent)
    assert {(r.doc_id, r.n, r.component_id) for r in members.collect()} == set(brute.similar(docs, 3, percent))


@pytest.mark.parametrize("percent", [85, 80])
def test_candidates_of_a_shared_half_are_linear(spark, percent):
    """Documents that share half of their words but do not link give no bucket that grows with their number."""
    rng = random.Random(6)
    half = words(rng, 60, 10**9)
    docs = spark.createDataFrame([(i, " ".join(half + words(rng, 60, 10**9))) for i in range(600)], SCHEMA).cache()
    pairs = []
    for n in (150, 600):
        part = docs.where(f"doc_id < {n}")
        sets = part.select("doc_id", F.encode("text", "utf-8").alias("body")).mapInArrow(ngram_join._sets(4), "doc_id long, sid long, sid2 long, n long, tokens array<long>, bits array<long>")
        signatures = ngram_join._signatures(sets.withColumnRenamed("doc_id", "node"), part, 4, percent)
        sizes = [r["count"] for r in signatures.groupBy("signature").count().collect()]
        pairs.append(sum(x * (x - 1) // 2 for x in sizes))
    assert pairs[1] <= 4.5 * pairs[0] + 100, pairs


def meetings(spark, docs, percent):
    """How many pairs of rows meet in buckets, before any other condition."""
    df = spark.createDataFrame(docs, SCHEMA)
    sets = df.select("doc_id", F.encode("text", "utf-8").alias("body")).mapInArrow(ngram_join._sets(4), "doc_id long, sid long, sid2 long, n long, tokens array<long>, bits array<long>")
    return ngram_join._meetings(ngram_join._signatures(sets.withColumnRenamed("doc_id", "node"), df, 4, percent), percent).where("node_a <> node_b").count()


@pytest.mark.parametrize(("own", "percent"), [(30, 85), (45, 80), (22, 90)])
def test_candidates_of_templates_are_linear(spark, own, percent):
    """Documents of one template share most words and do not link: pairs grow as the documents do."""
    rng = random.Random(own)
    common = words(rng, 200, 10**9)
    docs = [(i, " ".join(common + words(rng, own, 10**9))) for i in range(1200)]
    pairs = [meetings(spark, docs[:n], percent) for n in (300, 600, 1200)]
    assert all(b <= 2.5 * a + 300 for a, b in zip(pairs, pairs[1:], strict=False)), pairs


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_join_of_templates(spark, percent):
    """Own parts of all sizes beside a template, about the limit: some link, some do not, by size too."""
    rng = random.Random(percent)
    common = words(rng, 60, 10**9)
    docs = [(i, " ".join(common[: rng.choice((60, 60, 55))] + words(rng, rng.randrange(16), 10**9))) for i in range(90)]
    members, _ = ngram_join.similar_classes(spark.createDataFrame(docs, SCHEMA), 4, percent)
    assert {(r.doc_id, r.n, r.component_id) for r in members.collect()} == set(brute.similar(docs, 4, percent))


def test_join_of_long_texts(spark):
    rng = random.Random(7)
    base = words(rng, 60_000, 10**5)
    other = base[:50_000] + words(rng, 10_000, 10**5)
    docs = [(1, " ".join(base)), (2, " ".join(base[:59_000])), (3, " ".join(other)), (4, "a" * 300_000)]
    members, _ = ngram_join.similar_classes(spark.createDataFrame(docs, SCHEMA), 4, 85)
    assert {(r.doc_id, r.n, r.component_id) for r in members.collect()} == set(brute.similar(docs, 4, 85))


def test_join_edges(spark):
    assert ngram_join.similar_classes(spark.createDataFrame([], SCHEMA))[0].collect() == []
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text, 1), (7, text, 1), (7, text, 2), (9, text, 3), (3, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    members, _ = ngram_join.similar_classes(docs)
    assert sorted((r.doc_id or -1, r.component_id) for r in members.collect()) == [(-1, None), (3, 3), (7, 7), (7, 7), (9, 7)]
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 7]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (200, 200)]
    found = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41))
    assert found[101] == found[103] == 100


def shared_passages(seed):
    rng = random.Random(seed)
    passages = [words(rng, n, 10**6) for n in (49, 50, 51, 80, 130)]
    docs = []
    for i in range(30):
        text = []
        for _ in range(rng.randrange(4)):
            text += words(rng, rng.randrange(60), 10**6)
            p = rng.choice(passages)
            start = rng.choice((0, 0, rng.randrange(20)))
            text += p[start:]
        docs.append((i * 3 % 31, " ".join(text)))
    repeated = words(rng, 7, 3)
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, None), (53, ""), (54, " ".join(repeated * 20)), (55, " ".join(repeated * 30)), (56, "a\tb c  d")]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_words_equal_brute_force(spark, seed):
    docs = shared_passages(seed)
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA))
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == set(brute.repeats(docs))


def test_removal_edges(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text, "x"), (4, text, "y"), (4, text, "z"), (6, text, "y")], "doc_id long, text string, copy string")
    out = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert out == [(-1, 0), (4, 0), (4, 0), (6, 60)]


def test_texts_under_one_doc_id_lose_their_own_words(spark):
    """Two texts of one doc_id share passages with a smaller document at different places, and copies come in a large group."""
    rng = random.Random(11)
    one, two, fill = (words(rng, n, 10**6) for n in (60, 70, 200))
    docs = [(1, " ".join(one + ["x"] + two)), (5, " ".join(fill + one)), (5, " ".join(two)), (5, " ".join(words(rng, 90, 10**6)))]
    docs += [(100 + i, docs[1][1]) for i in range(300)] + [(99, " ".join(words(rng, 3, 10**6) * 20_000))]
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    want = {(5, 260): 60, (5, 70): 70, (5, 90): 0, (1, 131): 0, (99, 60_000): 0}
    assert {(r.doc_id, r.n_words): r.n_removed for r in out if r.doc_id < 100} == want
    assert all(r.n_removed == 260 for r in out if r.doc_id >= 100) and len(out) == len(docs)


def test_every_shift_shares_an_anchor(spark):
    """A passage of exactly the window's length is found wherever it starts in both documents."""
    rng = random.Random(5)
    passage = words(rng, 50, 10**6)
    docs = [(0, " ".join(words(rng, 7, 10**6) + passage))] + [(k + 1, " ".join(words(rng, k, 10**6) + passage + [f"end{k}"])) for k in range(31)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert all(r.n_removed == (50 if r.doc_id else 0) for r in out)


def benchmark_docs(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, n, 60))) for i, n in enumerate((3, 9, 10, 11, 25, 40))] + [(6, None), (7, "!!"), (10, "One, two-THREE")]
    docs = []
    for i in range(40):
        text = words(rng, rng.randrange(30), 60)
        if rng.random() < 0.6:
            w = rng.choice(items[:6])[1].split()
            a = rng.randrange(len(w))
            text += w[a : a + rng.choice((9, 10, 14))] + words(rng, 5, 60)
        docs.append((i, " . ".join(text)))
    return docs + [(90, None), (91, ""), (92, "x ONE two,three y"), (93, docs[1][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [16 << 20, 60])
def test_contamination_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = benchmark_docs(seed)
    d, t = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.judged(decontaminate.find_matches(d, t))
    import hashlib

    found = {(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.contaminated) for r in out.collect()}
    assert found == set(brute.contamination(docs, items))
    clean = decontaminate.remove_contaminated(d, t)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in brute.contamination(docs, items) if not x[5]}


def test_longest_matches_have_places(spark):
    item = [f"b{i}" for i in range(15)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 3 + item + ["y"]), 5)], "doc_id long, text string, spans int")
    tests = spark.createDataFrame([(4, " ".join(item))], "item_id long, text string")
    row = decontaminate.find_matches(docs, tests).first()
    assert [tuple(s) for s in row.spans] == [(4, 3, 0, 15)]


def test_matches_are_maximal(spark):
    """Every place where a match begins that no match from the place before holds, with its greatest length and a true location."""
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.choice((2, 5, 12, 30)), 3))) for i in range(12)]
    docs = [(i, " ".join(words(rng, rng.randrange(5, 60), 3) + rng.choice(items)[1].split() + ["-"] + rng.choice(items)[1].split()[:20])) for i in range(25)]
    out = decontaminate.find_matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), window=6)
    tests = [(i, t.split()) for i, t in items]
    long = [(i, t) for i, t in tests if len(t) >= 6]
    for r in out.collect():
        w = brute.item_words(r.text)

        def longest(p):
            return max((n for _, t in long for a in range(len(t)) for n in [next((k for k in range(min(len(w) - p, len(t) - a)) if w[p + k] != t[a + k]), min(len(w) - p, len(t) - a))]), default=0)

        at = [longest(p) for p in range(len(w))]
        want = {(p, n) for p, n in enumerate(at) if n >= 6 and not (p and at[p - 1] > n)}
        short = {(p, len(t)) for _, t in tests if len(t) < 6 for p in range(len(w)) if w[p : p + len(t)] == t}
        assert {(s.doc_start, s.length) for s in r.spans} == want | short
        for s in r.spans:
            assert any(i == s.item_id and t[s.item_start : s.item_start + s.length] == w[s.doc_start : s.doc_start + s.length] for i, t in tests)


def test_repetitive_texts_take_linear_space(spark):
    """A repetition of 20,000 words against itself, and a phrase of 20,000 items that a document repeats."""
    items = [(1, "a b c " * 7_000)] + [(i, f"the phrase that every one of these items does hold in it {i}") for i in range(2, 20_000)]
    docs = [(1, "a b c " * 7_000), (2, "the phrase that every one of these items does hold in it . " * 50), (3, "the phrase that nobody knows")]
    d, t = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.judged(decontaminate.find_matches(d, t)).collect()}
    assert out[1].n_hit == 21_000 and [s.length for s in out[1].spans] == [21_000]
    assert out[2].n_hit == 50 * 12 and len(out[2].spans) == 50 and len(out[2]["items"]) == 19_998
    assert not out[3].contaminated and not out[3].spans
    assert {r.doc_id for r in decontaminate.remove_contaminated(d, t).collect()} == {3}


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], SCHEMA)
    assert [r.contaminated for r in decontaminate.judged(decontaminate.find_matches(docs, none)).collect()] == [False] * 3
    assert decontaminate.remove_contaminated(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
