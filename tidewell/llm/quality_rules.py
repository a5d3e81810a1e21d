"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
a an and are as at be by for from has have he her his in is it not of on or she that the their they this to was were which with you
au avec ce dans de des du elle en est et il je la le les mais ne nous ou par pas plus pour que qui se son sur un une vous
aber auch auf aus bei das dem den der des die durch ein eine einer er es für hat ich im ist mit nach nicht sich sie sind und von war wie wird zu zum
al como con del el ella ellos era está esta este fue ha la las lo los más muy no nos para pero por que se ser si sin su sus una y ya
""".split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """keeps a document if low <= measure / per <= high; a document with no `per` passes."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value, base = F.col(self.measure).cast("double"), F.col(self.per).cast("double")
        tests = [value >= self.low * base] * (self.low is not None) + [value <= self.high * base] * (self.high is not None)
        met = F.lit(True)
        for t in tests:
            met = met & t
        return (F.col(self.per) == 0) | met


#: Length, symbol, stop-word and line ratios. BASE is the floor every document has to pass.
BASE = (
    Rule("words", "n_words", "one", low=20),
    Rule("repeats", "n_repeat_words", "n_words", high=0.3),
)
RULES = (
    Rule("mean_word", "word_chars", "n_words", low=2, high=14),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop_words", "n_words", low=0.06),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullets", "n_bullet_lines", "n_lines", high=0.9),
    Rule("cut_lines", "n_open_lines", "n_lines", high=0.3),
)


def without(*names: str) -> tuple[Rule, ...]:
    """The rules but for some. The stop-word rule knows English, French, German and Spanish: without("stop_words") suits others."""
    return tuple(r for r in RULES if r.name not in names)


def measured(docs: DataFrame) -> DataFrame:
    """docs with the measures of the rules; columns of the same names are replaced.

    Null or empty text measures 0 everywhere. All measures are built-in expressions
    over one document: windows of words are hashed, sorted and compared in its row.
    """
    text = F.coalesce("text", F.lit(""))
    filled = lambda lines: F.filter(lines, lambda x: F.rlike(x, F.lit(r"[^\x09-\x0D\x20]")))
    df = docs.withColumns({"_words": words_of(F.col("text")), "_lines": filled(F.split(text, "\n"))})
    n = F.size("_words")
    # No lambda variable may be an argument of slice(), so starts and words are zipped by position.
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_hashes", hashes)
    # Only where a hash comes twice the windows are sorted by it; equal neighbours are repeats.
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda e, k: (F.get("_sorted", k - 1)["h"] == e["h"]) | (F.get("_sorted", k + 1)["h"] == e["h"])
    repeats = F.sort_array(F.transform(F.filter("_sorted", lambda e, k: F.coalesce(near(e, k), F.lit(False))), lambda e: e["i"]))
    covered = F.aggregate(
        repeats,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    long = lambda c: c.cast("long")
    df = df.withColumns({
        "n_words": long(n),
        "word_chars": long(F.length(F.array_join("_words", ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_bullet_lines": long(F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit("^[ \t]*[-*•]"))))),
        "n_open_lines": long(F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit("(\\.\\.\\.|…)[ \t\r]*$"))))),
        "n_stop_words": long(F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS)))),
        "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
        "one": F.lit(1),
    })
    return df.drop("_words", "_lines", "_hashes", "_sorted")


def apply_rules(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept, a row for each input row.

    docs needs text; other columns stay, and those named like a measure are replaced.
    A document is kept if it passes base and rules; documents in other languages than those of
    STOP_WORDS fail the stop-word rule, unless rules leave it out. Text that is null, empty or shorter
    than the base asks fails the base. Repeated rows get equal results; an empty table
    gives an empty result.
    """
    every = lambda some: F.forall(F.array(*[r.holds() for r in some]), lambda x: x)
    df = measured(docs).withColumns({"base_failed": ~every(base), "_passed": every(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & F.col("_passed")).drop("_passed", "one")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    # A filter on the projection's result; the struct keeps clashing names apart.
    judged = apply_rules(docs.select(F.struct("*").alias("_whole"), "text"), rules=rules).select("_whole", "kept")
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_whole"))).alias("_whole")).select("_whole.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"]
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def _sql(rules: tuple[Rule, ...]) -> str:
    return " AND ".join(
        f"({r.per} = 0 OR ({' AND '.join([f'{r.measure} >= {r.low}::DOUBLE * {r.per}'] * (r.low is not None) + [f'{r.measure} <= {r.high}::DOUBLE * {r.per}'] * (r.high is not None))}))" for r in rules
    )


#: The measures in SQL from documents; used for the operator's and the pipeline's oracle.
MEASURES_SQL = r"""
w AS (
  SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS ls FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS r(i) WHERE len(ws) >= 8),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS r FROM twice, unnest(range(0, 8)) AS u(j) GROUP BY doc_id),
measures AS (
  SELECT w.*, 1 AS one, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$')))::BIGINT AS n_open_lines,
    len(list_filter(ws, lambda x: list_contains([STOPS], lower(x))))::BIGINT AS n_stop_words, coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id))""".replace("STOPS", ", ".join(f"'{w}'" for w in STOP_WORDS))
VERDICT_SQL = f"NOT ({_sql(BASE)}) AS base_failed, ({_sql(BASE)}) AND ({_sql(RULES)}) AS kept"
OP5_SQL = f"""
WITH {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {VERDICT_SQL}, n_lines, n_stop_words FROM measures
"""
