"""Token counts by a count-only Viterbi search over the matches of a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; for each end
only the best score and its number of pieces are kept, no path. Of equal scores the
one whose last piece starts first stays, which is the tokenizer's rule.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: The offset in the Zipf-Mandelbrot law: a piece of rank r has a probability in proportion to 1 / (r + offset).
RANK_OFFSET = 200
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments whose counts a task keeps; the table is emptied when full.
MEMO = 500_000


def vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """Pieces and log-probabilities of a sentencepiece file; whether bytes stand for unknown characters.

    A unigram file's scores are taken as they are. A byte-pair file has ranks for scores, all whole
    numbers: a piece's rank then gives its probability by the Zipf-Mandelbrot law.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))}
    if all(s == int(s) for s in plain.values()):
        plain = {p: -math.log(RANK_OFFSET - s) for p, s in plain.items()}
    return plain, any(model.is_byte(i) for i in ids)


class Counter:
    """Counts the pieces of the best segmentation of normalised text."""

    def __init__(self, scores: dict[str, float], bytes_for_unknown: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.bytes, self.memo = bytes_for_unknown, {}
        # Where no piece has a space mark after another character, no path crosses the end of a word.
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.segments = None if any(inner.search(p) for p in scores) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __call__(self, text: str) -> tuple[int, int]:
        """(tokens, unknown characters) of a text."""
        if not text:
            return 0, 0
        text = SPACE + text.replace(" ", SPACE)
        if self.segments is None:
            return self.best(text)
        memo, tokens, unknown = self.memo, 0, 0
        for segment in self.segments.findall(text):
            found = memo.get(segment)
            if found is None:
                found = self.best(segment)
                if len(segment) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[segment] = found
            tokens += found[0]
            unknown += found[1]
        return tokens, unknown

    def best(self, text: str) -> tuple[int, int]:
        n = len(text)
        score, count, unknown = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        single = bytearray(n + 1)
        done = 0

        def settle(upto: int) -> None:
            """Ends whose last character is no piece: it may be unknown."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    other = score[done - 1] + self.unknown
                    if score[done] is None or other > score[done]:
                        run = 0 < unknown[done - 1] and not self.bytes and tail[done - 1]
                        score[done], tail[done] = other, 1
                        count[done] = count[done - 1] + (len(text[done - 1].encode("utf-8", "surrogatepass")) if self.bytes else 1 - bool(run))
                        unknown[done] = unknown[done - 1] + 1

        tail = bytearray(n + 1)
        for last, (length, value) in self.automaton.iter(text):
            settle(last)
            end, start = last + 1, last + 1 - length
            if length == 1:
                single[end] = 1
            other = score[start] + value
            if score[end] is None or other > score[end]:
                score[end], count[end], unknown[end], tail[end] = other, count[start] + 1, unknown[start], 0
        settle(n)
        return count[n], unknown[n]


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens and n_unknown of each row's whole text.

    docs needs doc_id and text; other columns are ignored. Null or empty text has 0 of
    each. The text gets a space mark in front and for every space, as the tokenizer
    does. Repeated rows are counted each; an empty table gives an empty result. The
    driver reads the vocabulary file and broadcasts the pieces (a vocabulary, so under
    a few MB whatever the data); nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*held.value)
        for piece in pieces(batches):
            texts = [b.decode() for b in piece.column("body").to_pylist()]
            tokens, unknown = zip(*map(counter, texts), strict=True)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(x, pa.int64()) for x in (map(len, texts), tokens, unknown))], ["doc_id", "n_chars", "n_tokens", "n_unknown"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return body.mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long, n_unknown long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
