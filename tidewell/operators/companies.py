"""Companies in sentences: mentions by a dictionary of names, subjects and topics, and names that a text contains.

Runs of words are looked up by an equi-join on a normal form, so a dictionary of any size
fits; the choice among overlapping runs is an ordered fold. Containment, which knows no
words, is an automaton over a block of names in each task.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ordered import by_row, fold
from .text import held

c = F.col

# Legal marks and suffixes of names, particles behind them, those of a subject, and what parts words.
MARKS = r"\(\s*주\s*\)|주식회사|\(\s*유\s*\)"
SUFFIXES = r"\bCO\.?,?\s*LTD\b\.?|\bCO\.(?![A-Z])|\bLTD\b\.?|\bINC\b\.?|\bCORP(?:ORATION\b|\.|\b)"
PARTICLES = (
    "으로서 으로써 에서는 에서도 에게서 으로는 이라는 보다는 와는 과는 에는 라는 에서 에게 으로 까지 부터 보다 처럼 마저 조차 이나 이며 이고 대비 은 는 이 가 을 를 의 에 도 와 과 로 만 나"
).split()
SUBJECT_PARTICLES = "은는이가"
PARTING = r"[\s,·/()\[\]\"“”‘’'「」]+"
ENDING = r"[.!?。:;…]+$"
#: The first two characters of a word (upper case) that are also those of its key: nothing that keys leave out begins there.
PLAIN = r"^(?:[ABD-HJKM-Z0-9가-힣&&[^주]]{2}|[ABD-HJKM-Z0-9][CIL])"
#: Words that one name has at most.
RUN = 3
#: Names in one automaton, and rows of a dictionary up to which it is broadcast.
MOST_NAMES = 100_000
_MARK = "\x02"


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Texts with width variants and one-character marks in their compatibility form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def name_key(name: Column) -> Column:
    """The form in which names (already folded) are compared: upper case, without legal marks, suffixes and blanks."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), f"{MARKS}|{SUFFIXES}", ""), r"[\s.,·]+", "")


def company_key(name: Column) -> Column:
    return name_key(folded(name))


def dictionary(names: DataFrame) -> DataFrame:
    """_key, name, company and common of names (name, company and, if given, common: an everyday word); one row for each form.

    Forms of less than two characters are no names. Of several companies with one form the smallest counts.
    """
    common = F.coalesce(c("common"), F.lit(False)) if "common" in names.columns else F.lit(False)
    keyed = names.select(company_key(c("name")).alias("_key"), "name", "company", common.alias("common")).where(F.length("_key") >= 2)
    return keyed.groupBy("_key").agg(F.min(F.struct("company", "name", "common")).alias("x")).select("_key", "x.*")


def _words(text: Column) -> Column:
    """Array of (word, left, right): words, and whether a legal mark stands before or behind them."""
    parted = F.filter(F.split(F.regexp_replace(text, MARKS, f" {_MARK} "), PARTING), lambda w: w != "")
    mark = lambda ws, i: F.coalesce((i >= 0) & (F.get(ws, F.greatest(i, F.lit(0))) == _MARK), F.lit(False))
    each = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), mark(ws, i - 1).alias("left"), mark(ws, i + 1).alias("right")))
    return F.filter(held(parted, each), lambda x: x["word"] != _MARK)


def _forms(surface: Column) -> Column:
    """A run as it is, and without each particle that it ends in, longest first."""
    fits = F.filter(F.array(*map(F.lit, sorted(PARTICLES, key=len, reverse=True))), lambda p: surface.endswith(p) & (F.length(surface) > F.length(p)))
    return F.concat(F.array(surface), F.transform(fits, lambda p: F.substr(surface, F.lit(1), F.length(surface) - F.length(p))))


def _promising(words: DataFrame, word: Column, known: DataFrame) -> DataFrame:
    """words without those at which no known name can begin, by its first two characters; the rest is looked up exactly."""
    starts = known.select(F.substring("_key", 1, 2).alias("_start")).distinct().withColumn("_begins", F.lit(True))
    if starts.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        return words
    marked = words.withColumn("_start", F.when(word.rlike(PLAIN), F.substring(word, 1, 2)))
    return marked.join(F.broadcast(starts), "_start", "left").where("_start is null or _begins").drop("_start", "_begins")


def mentions(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, at, words, name, company, subject and topic of the companies that texts mention, longest names first.

    texts has key, text and, if given, company: the one that the text is about; names are
    as in `dictionary`. at counts words from 0. A name that is an everyday word counts
    with a legal mark beside it, or as the text's own company. subject: the name stands
    before the end of the first word with a subject's particle, or there is none; topic:
    it has such a particle itself. Null text mentions nothing; texts need unique keys.
    """
    known = dictionary(names)
    own = F.col("company") if "company" in texts.columns else F.lit(None).cast(names.schema["company"].dataType)
    df = texts.select(key, own.alias("_own"), _words(folded(c("text"))).alias("w"))
    ends = F.transform("w", lambda x: F.regexp_replace(x["word"], ENDING, "").rlike(f"[{SUBJECT_PARTICLES}]$"))
    df = df.withColumn("_end", F.array_position(ends, F.lit(True)))
    runs = F.array(
        *[
            F.when(F.size("w") >= c("at") + n, F.struct(F.lit(n).alias("n"), F.transform(F.slice("w", c("at") + 1, F.lit(n)), lambda x: x["word"]).alias("ws"), F.exists(F.slice("w", c("at") + 1, F.lit(n)), lambda x: x["left"] | x["right"]).alias("marked")))
            for n in range(1, RUN + 1)
        ]
    )
    each = _promising(df.select(key, "_own", "_end", "w", F.posexplode("w").alias("at", "_x")), F.upper("_x.word"), known)
    each = each.select(key, "_own", "_end", "at", F.explode(F.array_compact(runs)).alias("r"))
    surface = F.regexp_replace(F.array_join("r.ws", " "), ENDING, "")
    forms = each.select(key, "_own", "_end", "at", c("r.n").alias("n"), "r.marked", surface.alias("surface")).select("*", F.posexplode(_forms(c("surface"))).alias("rank", "form"))
    forms = forms.withColumn("_key", name_key(c("form"))).where(F.length("_key") >= 2)
    known = F.broadcast(known) if names.count() <= MOST_NAMES else known
    hits = forms.join(known, "_key").where(~c("common") | c("marked") | F.coalesce(c("company") == c("_own"), F.lit(False)))
    best = hits.groupBy(key, "at", "n").agg(F.min_by(F.struct("name", "company", "_own", "_end", "surface", "_key"), "rank").alias("x"))

    def step(reach, row):
        free = row.at >= (reach or 0)
        return (row.at + row.n if free else reach), (bool(free),)

    chosen = fold(best.select(key, "at", "n", (-c("n")).alias("_shorter"), "x.*"), [key], ["at", "_shorter"], "kept boolean", by_row(step, ["kept"])).where("kept")
    subject = (c("_end") == 0) | (c("at") < c("_end"))
    bare = F.substr("surface", F.lit(1), F.length("surface") - 1)
    topic = subject & c("surface").rlike(f"[{SUBJECT_PARTICLES}]$") & (name_key(bare) == c("_key"))
    return chosen.select(key, "at", c("n").alias("words"), "name", "company", subject.alias("subject"), topic.alias("topic"), c("_own").alias("own"))


def subjects(found: DataFrame, key: str) -> DataFrame:
    """key, company, topic and other of mentions: the first company among the subjects, the first topic, and the name of
    the first other company where the text's own one is no subject; null where there is none."""
    first = lambda value, test: F.min_by(F.when(test, c(value)), F.when(test, c("at")))
    mine = F.bool_or(c("subject") & F.coalesce(c("company") == c("own"), F.lit(False)))
    return found.groupBy(key).agg(first("company", c("subject")).alias("company"), first("company", c("topic")).alias("topic"), F.when(~mine, first("name", c("subject"))).alias("other"))


def contained(texts: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """key, name and n: how often each text (key, text) holds each name (name), without overlaps of one name.

    No word bounds. One automaton holds a block of at most MOST_NAMES names, so a larger
    dictionary costs more passes over the texts and not more memory. Nothing is joined:
    work grows with the texts and what they hold. Null texts and empty names hold nothing.
    """
    spark = texts.sparkSession
    known = names.select("name").where("name <> ''").distinct()
    blocks = max(1, -(-known.count() // MOST_NAMES))
    kind = texts.schema[key].dataType.simpleString()
    made = None
    for block in range(blocks):
        mine = [r[0] for r in known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()]
        held_ = spark.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], held_=held_) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for n in held_.value:
                automaton.add_word(n, n)
            automaton.make_automaton()
            for batch in batches:
                at, found, times = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    counts, ends = Counter(), {}
                    for end, n in automaton.iter(text or "") if held_.value else ():
                        if end - len(n) >= ends.get(n, -1):
                            counts[n] += 1
                            ends[n] = end
                    at.extend([row] * len(counts))
                    found.extend(counts)
                    times.extend(counts.values())
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(times, pa.int64())], [key, "name", "n"])

        part = texts.select(key, "text").mapInArrow(run, f"`{key}` {kind}, name string, n long")
        made = part if made is None else made.unionByName(part)
    return made
