"""Quality classifier: a byte-level convolutional network in numpy.

Filters over runs of bytes slide over the whole document. Their responses are
max-pooled in overlapping chunks; the mean and the maximum over all chunks of a
document are combined into one probability.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

WIDTH, FILTERS = 6, 16
#: A chunk is 8 segments of 64 bytes; the next starts 7 segments later.
SEGMENT, CHUNK, STEP = 64, 8, 7
#: Segments convolved at once, which bounds memory for texts of any length.
BLOCK = 128
#: Rows, and bytes of text, of the labelled sample that is fitted.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 24 << 20


@dataclass
class Network:
    """tables: response of each filter to each byte at each place; head over mean and maximum."""

    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS
    offset: float

    @functools.cached_property
    def pairs(self) -> list[np.ndarray]:
        """Responses to two bytes at once, by their 16-bit number; halves the look-ups."""
        return [(self.tables[k][:, None] + self.tables[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]

    def segments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Maximal responses in each segment of data, whose length is a multiple of SEGMENT.

        The last places before a text's end, which would reach into the next text, respond
        as to zero bytes, so that a score depends on its own text only.
        """
        seams = (ends[:, None] - np.arange(WIDTH - 1, 0, -1)).ravel()
        nothing = sum((p[0] for p in self.pairs[1:]), self.pairs[0][0].copy())
        out = np.empty((len(data) // SEGMENT, FILTERS), np.float32)
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)]).astype(np.int64)
        two = (padded[:-1] << 8) | padded[1:]
        sums, more = (np.empty((BLOCK * SEGMENT, FILTERS), np.float32) for _ in range(2))
        for start in range(0, len(data), BLOCK * SEGMENT):
            stop = min(len(data), start + BLOCK * SEGMENT)
            n = stop - start
            np.take(self.pairs[0], two[start:stop], 0, sums[:n], "clip")
            for k in range(1, WIDTH // 2):
                sums[:n] += np.take(self.pairs[k], two[start + 2 * k : stop + 2 * k], 0, more[:n], "clip")
            a, b = np.searchsorted(seams, (start, stop))
            sums[seams[a:b] - start] = nothing
            out[start // SEGMENT : stop // SEGMENT] = sums[:n].reshape(-1, SEGMENT, FILTERS).max(1)
        return np.maximum(out + self.bias, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        data, counts = layout(texts)
        if not len(data):
            return np.empty(0)
        found = self.segments(data, np.cumsum(counts) * SEGMENT)
        starts = np.cumsum([0, *counts[:-1]])
        chunks = np.maximum(1, -(-(counts - CHUNK) // STEP) + 1)
        first = np.concatenate([s + STEP * np.arange(c) for s, c in zip(starts, chunks, strict=True)])
        last = np.minimum(first + CHUNK, np.repeat(starts + counts, chunks))
        pairs = np.stack([first, last], 1).ravel()
        pooled = np.maximum.reduceat(np.concatenate([found, found[-1:]]), pairs, 0)[::2]
        at = np.cumsum([0, *chunks[:-1]])
        mean = np.add.reduceat(pooled, at, 0) / chunks[:, None]
        features = np.concatenate([mean, np.maximum.reduceat(pooled, at, 0)], 1)
        return 1 / (1 + np.exp(-np.clip(features @ self.head + self.offset, -30, 30).astype(np.float64)))


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each filled with zero bytes to whole segments; segments of each."""
    counts = np.array([-(-(len(t) + WIDTH - 1) // SEGMENT) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(c * SEGMENT, b"\0") for t, c in zip(texts, counts.tolist(), strict=True)), np.uint8), counts


def fit(texts: list[bytes], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on the class-balanced log loss; gradients pass through each chunk's maximum.

    The last offset is moved so that equal odds of the balanced classes score 0.3.
    Without both classes the network scores the share of label 1 everywhere.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        net.head[:] = 0
        net.offset = float(np.log((share + 0.01) / (1.01 - share)))
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moments: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        m, v = moments.setdefault(name, [np.zeros_like(gradient), np.zeros_like(gradient)])
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient**2 - v)
        return value - rate * (1 - 0.9 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step += 1
            chunked, owner = [], []
            for k, r in enumerate(rows):
                data, counts = layout([texts[r]])
                data = np.concatenate([data, np.zeros(CHUNK * SEGMENT + WIDTH, np.uint8)])
                n = max(1, -(-(int(counts[0]) - CHUNK) // STEP) + 1)
                windows = np.lib.stride_tricks.sliding_window_view(data, CHUNK * SEGMENT + WIDTH)
                chunked.append(windows[np.minimum(np.arange(n) * STEP * SEGMENT, len(windows) - 1)])
                owner.extend([k] * n)
            x, owner = np.concatenate(chunked), np.array(owner)
            top, place = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
            for a in range(0, len(x), 128):
                sums = net.tables[0][x[a : a + 128, : CHUNK * SEGMENT]]
                for k in range(1, WIDTH):
                    sums += net.tables[k][x[a : a + 128, k : CHUNK * SEGMENT + k]]
                place[a : a + 128] = sums.argmax(1)
                top[a : a + 128] = np.take_along_axis(sums, place[a : a + 128, None, :], 1)[:, 0]
            pooled = np.maximum(top + net.bias, 0)
            at = np.searchsorted(owner, np.arange(len(rows)))
            sizes = np.bincount(owner, minlength=len(rows))[:, None]
            mean, most = np.add.reduceat(pooled, at, 0) / sizes, np.maximum.reduceat(pooled, at, 0)
            features = np.concatenate([mean, most], 1)
            p = 1 / (1 + np.exp(-np.clip(features @ net.head + net.offset, -30, 30)))
            error = (p - y[rows]) * weight[rows] / len(rows)
            back = error[:, None] * net.head[None, :]
            chunk_back = (back[:, :FILTERS] / sizes)[owner] + back[:, FILTERS:][owner] * (pooled == most[owner])
            chunk_back = (chunk_back * (pooled > 0)).astype(np.float32)
            gradient = np.zeros_like(net.tables)
            which = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                np.add.at(gradient[k], (x[np.arange(len(x))[:, None], place + k], which), chunk_back)
            net.head = adam("head", net.head, (features.T @ error + 1e-3 * net.head).astype(np.float32))
            net.offset = float(adam("offset", np.array([net.offset]), np.array([error.sum()]))[0])
            net.bias = adam("bias", net.bias, chunk_back.sum(0))
            net.tables = adam("tables", net.tables, gradient + 1e-5 * net.tables)
    net.offset += float(np.log(0.3 / 0.7))
    return net


def remainder(doc_id) -> object:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most `rows` rows outside the held-out fold, in hash order.

    Half the rows are for each class, as far as there are as many. Texts are whole; those
    that would pass most_bytes are left out of the sample.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).select("doc_id", "quality").distinct()
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("body"), F.octet_length("text").alias("bytes"))
    picked = found.where(F.col("bytes") <= most_bytes // 16).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).orderBy(F.xxhash64("doc_id"), "body").limit(rows)
    texts, marks, total = [], [], 0
    for row in picked.select("body", "quality").toLocalIterator():
        if total + len(row[0]) <= most_bytes:
            total += len(row[0])
            texts.append(bytes(row[0]))
            marks.append(int(row[1]))
    return texts, marks


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text; null and empty texts are scored as empty."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(held.value.scores(piece.column("body").to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored.
    Learns on a bounded sample of labels outside the held-out fold (crc32 of the
    doc_id's text modulo 5 is 0), and scores by text bytes alone. A null doc_id is not
    held out. A score at the threshold predicts 1; a doc_id with both labels counts for
    both. Rows that repeat are scored each; an empty table gives an empty result;
    without labels all scores are one share.
    """
    net = fit(*labelled_sample(docs, labels))
    scored = score(docs, net)
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
