"""Vector codes, language identification and the Merkle manifest."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import lang_id, merkle, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>"


def plain_codes(rows, rounds=6):
    """vec_id -> (code, error, label), and the digest; every part against every entry."""
    kept = [(v, lab, [math.floor(4096 * float(np.float32(x))) for x in e]) for v, lab, e in rows if e and len(e) % 8 == 0 and all(x is not None and math.isfinite(x) for x in e)]
    kept = [k for k in kept if len(k[2]) == len(min(kept, key=lambda k: (k[0] is None, k[0] or 0, k[2]))[2])]
    width = len(kept[0][2]) // 8
    part = lambda e, p: tuple(e[p * width : (p + 1) * width])
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[2]))[:16]
    books = [[part(e, p) for _, _, e in first] for p in range(8)]
    nearest = lambda e, p: min(range(len(books[p])), key=lambda j: (far(part(e, p), books[p][j]), j))
    for _ in range(rounds):
        for p in range(8):
            own = collections.defaultdict(list)
            for _, _, e in kept:
                own[nearest(e, p)].append(part(e, p))
            books[p] = [tuple(sum(x) // len(own[j]) for x in zip(*own[j], strict=True)) if own[j] else b for j, b in enumerate(books[p])]
    out = []
    for v, lab, e in kept:
        code = [nearest(e, p) for p in range(8)]
        out.append((v, "".join(f"{j:02x}" for j in code), sum(far(part(e, p), books[p][j]) for p, j in enumerate(code)), lab))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def clustered(seed, n, width=2):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.3) for _ in range(8 * width)] for _ in range(6)]
    return [(i, rng.choice((1, 2, None)), [x + rng.gauss(0, 0.02) for x in rng.choice(centers)]) for i in range(n)]


EDGES = [(900, 1, None), (901, 1, [float("nan")] + [0.0] * 15), (902, None, [None] + [0.0] * 15), (903, 1, [float("inf")] * 16), (904, 2, []), (905, 2, [0.0] * 8), (906, 2, [0.0] * 7), (None, 3, [0.1] * 16), (907, 1, [0.5] * 16), (907, 1, [0.5] * 16)]


@pytest.mark.parametrize(("seed", "n", "more"), [(1, 300, EDGES), (2, 40, []), (3, 9, []), (4, 1, [])])
def test_codes_equal_plain_rounds(spark, seed, n, more):
    rows = clustered(seed, n) + more
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit("clash")).repartition(3)
    coded, books = vector_codes.compress(df)
    want, digest = plain_codes(rows)
    assert books.digest() == digest
    total = collections.Counter()
    for _, _, error, label in want:
        total[label] += error
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect()]
    assert sorted(map(str, got)) == sorted(str((v, c, e, total[lab])) for v, c, e, lab in want)


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    coded, _ = vector_codes.compress(spark.createDataFrame(clustered(5, 60), VECTORS))
    one = sorted(map(str, vector_codes.with_label_errors(coded).collect()))
    monkeypatch.setattr(vector_codes, "MOST_LABELS", 0)
    assert sorted(map(str, vector_codes.with_label_errors(coded).collect())) == one


def test_no_vectors(spark):
    for rows in ([], [(1, 1, None)]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
        assert books is None and vector_codes.with_label_errors(coded).collect() == []
    assert vector_codes.with_label_errors(coded).columns == ["vec_id", "label", "code", "error", "label_error"]


def test_bounds_spare_scans_and_change_nothing():
    """With ties and equal entries the bounds give what a full comparison gives, and most parts are not scanned in late rounds."""
    rng = np.random.default_rng(3)
    x = rng.integers(-6, 7, (500, 8, 3)) + 1000 * rng.integers(0, 6, (500, 8, 1))
    books = vector_codes.Codebooks(x[:16].transpose(1, 0, 2).copy())
    held, scans = None, []
    for _ in range(7):
        code, upper, lower, scanned = books.assign(x, held)
        full = vector_codes.squares(x[:, :, None], books.entries[None]).argmin(2)
        assert (code == full).all()
        scans.append(scanned)
        held = code, vector_codes._outwards(upper, np.inf).astype(float), vector_codes._outwards(lower, -np.inf).astype(float)
        moved = books.entries.copy()
        for p in range(8):
            for j in range(16):
                if (code[:, p] == j).any():
                    moved[p, j] = x[code[:, p] == j, p].sum(0) // (code[:, p] == j).sum()
        books = vector_codes.Codebooks(moved, books.entries)
    assert scans[0] == 4000 and scans[-1] < 3000


def test_large_numbers_stay_exact():
    big = vector_codes.integers(np.array([1 << 30, -(1 << 30)] * 8), 2)
    assert big.dtype == object
    books = vector_codes.Codebooks(big.transpose(1, 0, 2).copy())
    code, _, _, _ = books.assign(big, None)
    assert books.errors(big, code).tolist() == [0, 0]


# --- language identification


def network(langs=2, seed=0):
    rng = np.random.default_rng(seed)
    layer = lambda: lang_id.Layer(*(rng.normal(0.3, 0.6, s).astype(np.float32) for s in ((3 * lang_id.UNITS, 256), (3 * lang_id.UNITS, lang_id.UNITS), (langs, lang_id.UNITS))))
    return lang_id.Network([f"l{k}" for k in range(langs)], layer(), layer(), rng.normal(0, 0.3, (langs, 1)).astype(np.float32))


def plain_states(layer, data):
    u, h, out = lang_id.UNITS, np.zeros(lang_id.UNITS), []
    for b in data:
        x, a = layer.bytes_[:, b].astype(float), layer.state.astype(float) @ h
        keep, reset = np.clip(x[:u] + a[:u], 0, 1), np.clip(x[u : 2 * u] + a[u : 2 * u], 0, 1)
        fresh = np.clip(x[2 * u :] + reset * a[2 * u :], -1, 1)
        h = keep * h + (1 - keep) * fresh
        out.append(h)
    return out


def plain_probabilities(net, text, chunk, context):
    """Position by position, chunk by chunk."""
    rows = []
    for a in range(0, len(text), chunk):
        first, last = max(0, a - context), min(len(text), a + chunk + context)
        part = text[first:last]
        ahead, back = plain_states(net.forward, part), plain_states(net.backward, part[::-1])[::-1]
        for i in range(a, min(a + chunk, len(text))):
            logits = net.forward.out @ ahead[i - first] + net.backward.out @ back[i - first] + net.offset[:, 0]
            e = np.exp(logits - logits.max())
            rows.append(e / e.sum())
    return np.array(rows)


def test_network_equals_plain_loop(monkeypatch):
    monkeypatch.setattr(lang_id, "CHUNK", 20)
    monkeypatch.setattr(lang_id, "CONTEXT", 5)
    monkeypatch.setattr(lang_id, "ROWS", 7)
    net, rng = network(3, 1), random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 19, 20, 21, 24, 25, 26, 40, 133, 5)]
    means, labels = net.run(texts, label=True)
    for t, mean, marks in zip(texts, means, labels, strict=True):
        if t:
            want = plain_probabilities(net, t, 20, 5)
            assert np.allclose(mean, want.mean(0), atol=2e-5) and (marks == want.argmax(1)).mean() > 0.99
        else:
            assert not mean.any() and len(marks) == 0
    alone = np.stack([net.run([t])[0][0] for t in texts])
    assert np.allclose(alone, means, atol=1e-6)


def test_gradients_equal_differences():
    """Backpropagation through time against small changes of the weights."""
    rng = np.random.default_rng(5)
    learner = lang_id._Learner(["a", "b", "c"], rng, 0.1, np.float64)
    codes, labels = rng.integers(0, 6, (9, 4)), np.array([0, 1, 2, 1])
    there = (np.arange(9)[:, None] < np.array([9, 5, 1, 7])).astype(float)
    _, back, offset = learner.gradients(codes, there, labels)
    for k, layer in enumerate(learner.layers):
        for name, gradient in back[k].items():
            value = getattr(layer, name)
            for at in [tuple(rng.integers(0, s) for s in (value.shape[0], min(6, value.shape[1]))) for _ in range(12)]:
                kept, loss = value[at], []
                for sign in (1, -1):
                    value[at] = kept + sign * 1e-5
                    loss.append(learner.gradients(codes, there, labels)[0])
                value[at] = kept
                assert gradient[at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=2e-5), (name, at)
    loss = []
    for change in (1e-5, -2e-5):
        learner.offset[1] += change
        loss.append(learner.gradients(codes, there, labels)[0])
    assert offset[1, 0] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=2e-5)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, lang_id.fit(*lang_id.labelled_sample(docs))


def test_languages_of_held_out_documents(spark, learned):
    docs, net = learned
    found = lang_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.count(), found.where("lang = lang_pred").count()
    assert n > 150 and right >= 0.97 * n
    assert lang_id.predict(docs, net).where("score not between 0 and 1").count() == 0
    ids = {r.doc_id for r in found.collect()}
    assert ids == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def test_positions_tell_where_a_language_ends(spark, learned):
    docs, net = learned
    long = {r.lang: r.text[:900] for r in docs.where("length(text) > 2000 and lang in ('en', 'fr')").orderBy("doc_id").collect()}
    both = long["en"] + long["fr"]
    runs = lang_id.labelled_runs(spark.createDataFrame([(1, both)], "doc_id long, text string"), net).collect()
    size, edge = len(both.encode()), len(long["en"].encode())
    assert sorted((r.start, r.stop) for r in runs)[0][0] == 0 and sum(r.stop - r.start for r in runs) == size
    right = sum(max(0, min(r.stop, edge) - r.start) for r in runs if r.lang == "en") + sum(max(0, r.stop - max(r.start, edge)) for r in runs if r.lang == "fr")
    assert right > 0.8 * size


def test_language_edges(spark):
    kind = "doc_id long, text string, lang string, score int"
    assert lang_id.identify(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 !?", "de", 1), (None, "words here", "en", 1), (None, "words here", "en", 1)]
    out = lang_id.identify(spark.createDataFrame(rows, kind))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)} and out.count() == 5
    usable = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:4]
    one = lang_id.identify(spark.createDataFrame([(usable[0], "only this " * 50, "xx", 1), (usable[1], "7", "yy", 1), (usable[2], "x", None, 1), (usable[3], "é" * 100_000, None, 1)], kind)).collect()
    assert sorted((r.lang_pred, round(r.score, 6)) for r in one) == [("und", 0.0), ("xx", 1.0), ("xx", 1.0), ("xx", 1.0)]


# --- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = {i: i + 32 for i in range(65, 91)}
    trees, out = collections.defaultdict(list), []
    for doc_id, source, lang, n, text in rows:
        head = field(doc_id) + field(source) + field(lang) + field(n)
        moved = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        leaf = digest(head, field(text))
        trees[lang].append((doc_id, leaf, digest(head, field(text.translate(lower) if text is not None else None)) if moved else leaf))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))

    def grown(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    for lang in order:
        trees[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    levels = {lang: grown([x[1] for x in trees[lang]]) for lang in order}
    top = grown([levels[lang][-1][0] for lang in order])
    for place, lang in enumerate(order):
        for i, (doc_id, leaf, other) in enumerate(trees[lang]):
            proof, folded = "", other
            for all_, at in ((levels[lang], i), (top, place)):
                for level in all_[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    before, after = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
                    proof, folded, at = proof + before + after, digest(before, folded, after), at // 8
            out.append((doc_id, leaf, levels[lang][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string"


@pytest.mark.parametrize(("n", "depth"), [(0, 3), (1, 3), (9, 3), (150, 3), (150, 1), (700, 2)])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 8**depth)
    rng = random.Random(n)
    langs = ["en", "en", "en", "de", "é", "", None, "Z"] + [f"x{i}" for i in range(11)]
    rows = [(rng.choice((i, i, None)) if i % 10 == 0 else i, rng.choice(("s", None)), rng.choice(langs), rng.choice((None, 5)), rng.choice((None, "", "Some Text é", "lower", f"T{i}"))) for i in range(n)]
    rows += rows[:5] * 2
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(5)
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_manifest(rows)))


def test_tampered_rows_fail(spark):
    rows = [(i, "s", "en", 1, "Text") for i in range(60)]
    out = merkle.manifest(spark.createDataFrame([(*r, "") for r in rows], DOCS)).collect()
    assert {r.doc_id for r in out if not r.verified} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 0}
