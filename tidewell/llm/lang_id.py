"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two recurrent layers of gated units read a text's bytes forwards and backwards; every
position gets the probabilities of the languages from both states, and a document the
mean over its positions. Texts are cut into chunks that start a few bytes early and end
a few late, so that the states at a chunk's own positions are warm; chunks run side by
side. Gates and states are piecewise linear, and the weights are learned by
backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, table

UNITS = 8
#: Bytes that a chunk labels, and those read before and after them.
CHUNK, CONTEXT = 384, 16
#: Chunks that run side by side.
ROWS = 2048
#: What is fitted: documents of each language, languages (the most frequent), passages of a document and their characters.
SAMPLE_DOCS, MOST_LANGS, PASSAGES, PASSAGE = 240, 64, 3, 112
UNKNOWN = "und"


@dataclass
class Layer:
    """One direction: responses of the gates (keep, reset, candidate) to each byte, and to the state."""

    bytes_: np.ndarray  # 3 * UNITS x 256
    state: np.ndarray  # 3 * UNITS x UNITS
    out: np.ndarray  # languages x UNITS

    def step(self, codes: np.ndarray, h: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> None:
        """Moves the states h (UNITS x rows) on by one byte each, in place."""
        n = h.shape[1]
        x, a = (r[:, :n] for r in room)
        np.take(self.bytes_, codes, 1, out=x, mode="clip")
        np.matmul(self.state, h, out=a)
        gates, fresh = x[: 2 * UNITS], x[2 * UNITS :]
        gates += a[: 2 * UNITS]
        np.clip(gates, 0, 1, out=gates)
        inner = a[2 * UNITS :]
        inner *= gates[UNITS:]
        fresh += inner
        np.clip(fresh, -1, 1, out=fresh)
        h -= fresh
        h *= gates[:UNITS]
        h += fresh


@dataclass
class Network:
    langs: list[str]
    forward: Layer
    backward: Layer
    offset: np.ndarray  # languages x 1

    def chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, first byte, bytes before and bytes of each chunk's own positions, over the joined texts."""
        owner, first, before, own = [], [], [], []
        start = 0
        for k, t in enumerate(texts):
            at = np.arange(0, len(t), CHUNK)
            lead = np.minimum(at, CONTEXT)
            owner.append(np.full(len(at), k))
            first.append(start + at - lead)
            before.append(lead)
            own.append(np.minimum(CHUNK, len(t) - at))
            start += len(t)
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (owner, first, before, own))

    def run(self, texts: list[bytes], label: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Mean probabilities (texts x languages; zeros for an empty text) and, if wanted, each position's language number."""
        data = np.frombuffer(b"".join(texts) + bytes(CONTEXT), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        owner, first, before, own = self.chunks(texts)
        after = np.minimum(CONTEXT, (ends[owner] if len(owner) else ends[:0]) - (first + before + own))
        length = before + own + after
        sums = np.zeros((len(texts), len(self.langs)))
        labels = [np.zeros(n, np.int16) for n in lengths] if label else []
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), ROWS):
            rows = order[a : a + ROWS]
            steps, n = int(length[rows[0]]), len(rows)
            live = np.searchsorted(-length[rows], -np.arange(steps), "left")  # chunks longer than each step
            codes = data[np.minimum(first[rows] + np.arange(steps)[:, None], len(data) - 1)].astype(np.intp)
            logits = np.empty((steps, len(self.langs), n), np.float32)
            room = np.empty((3 * UNITS, n), np.float32), np.empty((3 * UNITS, n), np.float32)
            h = np.zeros((UNITS, n), np.float32)
            for t in range(steps):
                m = live[t]
                self.forward.step(codes[t, :m], h[:, :m], room)
                np.matmul(self.forward.out, h[:, :m], out=logits[t, :, :m])
            low, high = before[rows], before[rows] + own[rows]
            h = np.zeros((UNITS, n), np.float32)
            total = np.zeros((len(self.langs), n), np.float32)
            for t in range(steps - 1, -1, -1):
                m = live[t]
                self.backward.step(codes[t, :m], h[:, :m], room)
                at = logits[t, :, :m]
                at += self.backward.out @ h[:, :m]
                at += self.offset
                np.minimum(at, 60, out=at)
                np.exp(at, out=at)
                inside = (low[:m] <= t) & (t < high[:m])
                total[:, :m] += at * (inside / at.sum(0))
            np.add.at(sums, owner[rows], total.T)
            if label:
                best = logits.argmax(1)
                for j, r in enumerate(rows.tolist()):
                    here = int(first[r] + before[r] - (ends[owner[r]] - lengths[owner[r]]))
                    labels[owner[r]][here : here + own[r]] = best[before[r] : before[r] + own[r], j]
        return sums / np.maximum(lengths, 1)[:, None], labels


class _Learner:
    """Adam over all weights of both layers; gradients go back through all steps of a passage."""

    def __init__(self, langs: list[str], rng: np.random.Generator, rate: float, kind: type = np.float32):
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(kind)
        self.kind = kind
        self.layers = [Layer(draw(3 * UNITS, 256), draw(3 * UNITS, UNITS), draw(len(langs), UNITS)) for _ in range(2)]
        self.offset = np.zeros((len(langs), 1), kind)
        for one in self.layers:
            one.bytes_[: 2 * UNITS] = 0.5 + 0.3 * one.bytes_[: 2 * UNITS]
        self.rate, self.steps, self.moments = rate, 0, {}

    def _forward(self, layer: Layer, codes: np.ndarray, there: np.ndarray, ways: range) -> list[tuple]:
        h, kept = np.zeros((UNITS, codes.shape[1]), self.kind), [None] * len(codes)
        for t in ways:
            x, a = np.take(layer.bytes_, codes[t], 1), layer.state @ h
            raw = x[: 2 * UNITS] + a[: 2 * UNITS]
            gates = np.clip(raw, 0, 1)
            inner = a[2 * UNITS :]
            loose = x[2 * UNITS :] + gates[UNITS:] * inner
            fresh = np.clip(loose, -1, 1)
            after = (fresh + gates[:UNITS] * (h - fresh)) * there[t]
            kept[t] = (h, raw == gates, gates, inner, loose == fresh, fresh, after)
            h = after
        return kept

    def _back(self, layer: Layer, codes: np.ndarray, there: np.ndarray, ways: range, kept: list[tuple], error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of one layer; error: steps x languages x rows."""
        out, state = np.zeros_like(layer.out), np.zeros_like(layer.state)
        inputs, later = np.empty((len(codes), 3 * UNITS, codes.shape[1]), self.kind), np.zeros((UNITS, codes.shape[1]), self.kind)
        for t in reversed(ways):
            h, open_, gates, inner, free, fresh, after = kept[t]
            out += error[t] @ after.T
            grown = (later + layer.out.T @ error[t]) * there[t]
            keep, reset = gates[:UNITS], gates[UNITS:]
            d_fresh = grown * (1 - keep) * free
            d_gates = np.concatenate([grown * (h - fresh), d_fresh * inner]) * open_
            inputs[t] = np.concatenate([d_gates, d_fresh])
            to_state = np.concatenate([d_gates, d_fresh * reset])
            state += to_state @ h.T
            later = grown * keep + layer.state.T @ to_state
        flat = codes.ravel()
        bytes_ = np.stack([np.bincount(flat, inputs[:, k].ravel(), 256) for k in range(3 * UNITS)]).astype(self.kind)
        return {"bytes_": bytes_, "state": state, "out": out}

    def _adam(self, name: str, value: np.ndarray, gradient: np.ndarray) -> None:
        m, v = self.moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        value -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)

    def gradients(self, codes: np.ndarray, there: np.ndarray, labels: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]], np.ndarray]:
        """Mean log loss over the positions, and its gradients: of each layer and of the offset."""
        ways = range(len(codes)), range(len(codes) - 1, -1, -1)
        kept = [self._forward(layer, codes, there, way) for layer, way in zip(self.layers, ways, strict=True)]
        logits = sum(np.stack([layer.out @ k[-1] for k in states]) for layer, states in zip(self.layers, kept, strict=True)) + self.offset
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = there / there.sum()
        loss = -float((np.log(p[:, labels, np.arange(len(labels))] + 1e-12) * weight).sum())
        p[:, labels, np.arange(len(labels))] -= 1
        error = p * weight[:, None]
        back = [self._back(layer, codes, there, way, states, error) for layer, way, states in zip(self.layers, ways, kept, strict=True)]
        return loss, back, error.sum((0, 2))[:, None]

    def learn(self, codes: np.ndarray, there: np.ndarray, labels: np.ndarray) -> float:
        loss, back, offset = self.gradients(codes, there, labels)
        self.steps += 1
        for k, (layer, found) in enumerate(zip(self.layers, back, strict=True)):
            for name, gradient in found.items():
                size = np.sqrt((gradient**2).sum())
                self._adam(f"{name}{k}", getattr(layer, name), gradient / max(1.0, size))
        self._adam("offset", self.offset, offset)
        return loss


def fit(passages: list[bytes], langs: list[str], epochs: int = 16, batch: int = 192, rate: float = 0.03, seed: int = 3) -> Network:
    """A network for the languages of the passages; without passages it knows none."""
    known = sorted(set(langs))
    rng = np.random.default_rng(seed)
    learner = _Learner(known, rng, rate)
    number = {x: k for k, x in enumerate(known)}
    labels = np.array([number[x] for x in langs], np.int64)
    longest = max(map(len, passages), default=0)
    codes = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in passages), np.uint8).reshape(len(passages), longest).T.astype(np.int64)
    there = (np.arange(longest)[:, None] < np.array([len(p) for p in passages])[None]).astype(np.float32)
    batches = max(1, len(passages) // batch)
    for epoch in range(epochs if len(known) > 1 else 0):
        learner.rate = rate * (1 - 0.9 * epoch / epochs)
        for rows in np.array_split(rng.permutation(len(passages)), batches):
            learner.learn(codes[:, rows], there[:, rows], labels[rows])
    small = lambda layer: Layer(*(np.ascontiguousarray(a, np.float32) for a in (layer.bytes_, layer.state, layer.out)))
    return Network(known, small(learner.layers[0]), small(learner.layers[1]), learner.offset.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, most_langs: int = MOST_LANGS) -> tuple[list[bytes], list[str]]:
    """Passages and languages of at most docs_each documents of each of the most frequent languages, outside the held-out fold.

    Documents come in hash order: those below a rate by the language's count are read, and
    of these the first ones taken, so that no task or driver holds more than the sample.
    Passages start at hashed places, so all parts of a text are met.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return [], []
    place = lambda *more: F.pmod(F.xxhash64("doc_id", *more), F.lit(1 << 40))
    rate = lambda n: min(1.0, 3 * docs_each / n)
    near = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(rate(n) * (1 << 40)))])[F.col("lang")]
    read = usable.where(F.col("lang").isin(*counts)).withColumn("_place", place()).where((F.col("_place") < near) & has_letter(F.col("text")))
    room = F.greatest(F.char_length("text") - PASSAGE, F.lit(0)) + 1
    cuts = F.array(*[F.substr("text", (F.pmod(place(F.lit(k)), room) + 1).cast("int"), F.lit(PASSAGE)) for k in range(PASSAGES)])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id", "cuts"))
    rows = read.select("lang", "_place", "doc_id", F.array_distinct(cuts).alias("cuts")).withColumn("_nth", nth).where(F.col("_nth") <= docs_each).collect()
    rows.sort(key=lambda r: (r["lang"], r["_nth"]))
    return [c.encode() for r in rows for c in r["cuts"]], [r["lang"] for r in rows for _ in r["cuts"]]


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, over all bytes of its text."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for piece in pieces(batches, size=2 << 20):
            bodies = piece.column("body").to_pylist() if net.langs else [None] * piece.num_rows
            means = net.run([b or b"" for b in bodies])[0] if net.langs else np.zeros((len(bodies), 1))
            best = means.argmax(1)
            langs = [UNKNOWN if b is None else net.langs[k] for k, b in zip(best, bodies, strict=True)]
            scores = [0.0 if b is None else min(1.0, float(m[k])) for m, k, b in zip(means, best, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = F.when(has_letter(F.col("text")), F.col("text").cast("binary"))
    found = docs.select("doc_id", body.alias("body")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def labelled_runs(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and, for every run of positions with one language, its first byte, the byte after its last, and the language."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for piece in pieces(batches, size=1 << 20):
            ids, out = piece.column("doc_id").to_pylist(), []
            for doc_id, marks in zip(ids, net.run(piece.column("body").to_pylist(), label=True)[1], strict=True):
                edges = np.flatnonzero(np.diff(marks)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(marks)], strict=True):
                    if b > a:
                        out.append((doc_id, a, b, net.langs[marks[a]]))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], piece.column("doc_id").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["doc_id", "start", "stop", "lang"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(has_letter(F.col("text"))) if net.langs else docs.limit(0)
    return rows.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(run, f"doc_id {kind}, start long, stop long, lang string")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs.

    docs needs doc_id, text and lang; other columns are ignored. Learns on passages of a
    bounded sample of the rows with a language and a letter whose crc32 of the doc_id's
    text modulo 4 is not 2; a null doc_id is not held out and not learned from. Scores
    come from the text alone. A text that is null or has no letter, and every text where
    nothing could be learned, is `und` with score 0. Equal probabilities give the
    language that sorts first. Repeated rows are predicted each; an empty table gives an
    empty result.
    """
    return predict(docs, fit(*labelled_sample(docs)))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
