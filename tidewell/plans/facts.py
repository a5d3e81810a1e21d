"""FC: fact checks over filed amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators import claims as K
from tidewell.operators import companies
from tidewell.operators import factcheck as X
from tidewell.operators import periods as P
from tidewell.operators.markup import spread
from tidewell.sources.views import CLAIMS, FACTS, claims, facts, table

c = F.col
_KINDS = (("year", 0, False), ("quarter", 2, False), ("quarter", 3, True), ("half", 1, False), ("half", 2, False))


def _by_key(*texts):
    """One of the texts for each order, in turn by its key."""
    return F.element_at(F.array(*(t if isinstance(t, Column) else F.lit(t) for t in texts)), (c("o_orderkey") % len(texts) + 1).cast("int"))


def _case(*texts: str) -> str:
    return f"CASE o_orderkey % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


_P = f"p AS (SELECT o_orderkey, year(o_orderdate) AS year, {_case(*(repr(k) for k, _, _ in _KINDS))} AS kind, {_case(*(str(n) for _, n, _ in _KINDS))} AS n, {_case(*(str(q).lower() for _, _, q in _KINDS))} AS cumulative FROM orders)"


@query("fc13_periods", f"WITH {_P}, s AS (SELECT *, CASE WHEN kind = 'year' OR cumulative OR (kind = 'half' AND n = 1) THEN make_date(year, 1, 1) WHEN kind = 'half' THEN make_date(year, 7, 1) ELSE make_date(year, 3 * n - 2, 1) END AS a, last_day(make_date(year, 3 * CASE kind WHEN 'year' THEN 4 WHEN 'half' THEN 2 * n ELSE n END, 1)) AS b FROM p) SELECT o_orderkey, kind, n, cumulative, a AS start, b AS end_day FROM s")
def fc13(spark, d):
    """A period of some kind in the year of each order."""
    kind, n, cumulative = (_by_key(*x) for x in zip(*_KINDS, strict=True))
    p = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), kind.alias("kind"), n.alias("n"), cumulative.alias("cumulative"))
    return p.select("o_orderkey", "kind", "n", "cumulative", X.period_start(c("year"), c("kind"), c("n"), c("cumulative")).alias("start"), X.period_end(c("year"), c("kind"), c("n")).alias("end_day"))


@query("fc09_period_labels", "WITH o AS (SELECT o_orderkey, date_trunc(CASE o_orderkey % 2 WHEN 0 THEN 'year' ELSE 'quarter' END, o_orderdate)::DATE AS a, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS b FROM orders) SELECT o_orderkey, CASE WHEN month(b) = 12 AND month(a) = 1 THEN year(b)::VARCHAR WHEN month(b) = 6 AND month(a) = 1 THEN year(b) || 'H1' ELSE year(b) || 'Q' || quarter(b) END AS label FROM o")
def fc09(spark, d):
    day = F.to_date("o_orderdate")
    start = F.when(c("o_orderkey") % 2 == 0, F.trunc(day, "year")).otherwise(F.trunc(day, "quarter"))
    return table(spark, d, "orders").select("o_orderkey", X.period_label(start, F.last_day(F.add_months(F.trunc(day, "quarter"), 2))).alias("label"))


@query("fc13_finished_quarter", "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, date_trunc('quarter', o_orderdate)::DATE AS q FROM orders), a AS (SELECT *, CASE WHEN last_day((q + INTERVAL 2 MONTH)::DATE) <= d THEN q ELSE (q - INTERVAL 3 MONTH)::DATE END AS f FROM o) SELECT o_orderkey, year(f) || 'Q' || quarter(f) AS label FROM a")
def fc13b(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.finished_quarter(F.to_date("o_orderdate")).alias("label"))


def _filed(spark, d):
    """Half-year reports of each company: two statements, the second quarter and the first half as comma text."""
    f = facts(spark, d)
    q = lambda n: F.sum(F.when(c("quarter") == n, c("amount")))
    wide = f.groupBy("company", "year").agg(q(1).alias("q1"), q(2).alias("q2")).where("q1 is not null and q2 is not null")
    text = lambda x: F.format_number(x, 0)
    base = wide.select("company", "year", F.lit("11012").alias("code"), F.lit("revenue").alias("account"), text(c("q2")).alias("thstrm"), text(c("q1") + c("q2")).alias("thstrm_add"), F.lit("-").alias("frmtrm_q"), F.lit("").alias("frmtrm_add"), F.lit(None).cast("string").alias("frmtrm"), F.lit(None).cast("string").alias("bfefrmtrm"))
    return base.withColumn("statement", F.lit("IS")).union(base.withColumns({"thstrm": F.lit("1")}).withColumn("statement", F.lit("CIS")))


@query("fc08_filed_columns", f"WITH {FACTS}, w AS (SELECT company, year, sum(amount) FILTER (quarter = 1) AS q1, sum(amount) FILTER (quarter = 2) AS q2 FROM facts GROUP BY 1, 2) SELECT company, year || 'Q2' AS period, false AS cumulative, q2::BIGINT AS amount FROM w WHERE q1 IS NOT NULL AND q2 IS NOT NULL UNION ALL SELECT company, year || 'H1', true, (q1 + q2)::BIGINT FROM w WHERE q1 IS NOT NULL AND q2 IS NOT NULL")
def fc08(spark, d):
    return X.filed_facts(_filed(spark, d)).select("company", "period", "cumulative", "amount")


@query("fc10_report_kinds", "WITH o AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y FROM orders) SELECT o_orderkey, " + _case("'annual'", "'half'", "'quarter'", "NULL", "NULL") + " AS type, " + _case("y", "y || 'H1'", "y || 'Q3'", "NULL", "NULL") + " AS period, o_orderkey % 5 = 2 AS corrected FROM o")
def fc10(spark, d):
    """Report names with the year of each order."""
    y = F.year("o_orderdate")
    names = (("사업보고서 (%d.12)"), ("반기보고서 (%d.06)"), ("[기재정정]분기보고서 (%d.09)"), ("분기보고서 (%d.06)"))
    name = _by_key(*(F.format_string(n, y) for n in names), "주요사항보고서")
    r = table(spark, d, "orders").select("o_orderkey", name.alias("name")).withColumn("k", X.report_kind(c("name")))
    return r.select("o_orderkey", "k.type", "k.period", c("name").contains("[기재정정]").alias("corrected"))


@query("fc11_latest_filings", "SELECT o_custkey, year(o_orderdate)::INT AS year, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS filing FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2")
def fc11(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '1-URGENT'").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("filing"))


@query("fc07_unit_to_won", "SELECT p_partkey, (p_size::BIGINT * CASE p_partkey % 3 WHEN 0 THEN 1000000 WHEN 1 THEN 100000000 ELSE 1 END)::DOUBLE AS won FROM part")
def fc07(spark, d):
    unit = F.element_at(F.array(F.lit("백만원"), F.lit("억원"), F.lit("원")), (c("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.won(c("p_size"), unit).cast("double").alias("won"))


@query("fc06_preliminary_facts", f"WITH {FACTS} SELECT company, year || 'Q' || quarter AS period, (round(amount / 1000000.0) * 1000000)::BIGINT AS amount, 1000000::BIGINT AS rounding_unit FROM facts")
def fc06(spark, d):
    """Preliminary figures are filed in a rounded unit, which the fact keeps."""
    unit = F.lit(1_000_000).cast("bigint")
    return facts(spark, d).select("company", F.concat("year", F.lit("Q"), "quarter").alias("period"), (F.round(c("amount") / unit) * unit).cast("bigint").alias("amount"), unit.alias("rounding_unit"))


#: Orders with what their sentences are woven from; ay and aq are the last quarter that has ended by the order's day.
_O = """o AS (SELECT o_orderkey, o_custkey, c_mktsegment AS seg, y, q, n, k, greatest(n, 2) AS m, year(f) AS ay, quarter(f) AS aq, 2000 + y % 100 AS yy FROM (
  SELECT *, CASE WHEN last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) <= o_orderdate::DATE THEN date_trunc('quarter', o_orderdate)::DATE ELSE (date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH)::DATE END AS f FROM (
    SELECT o_orderkey, o_custkey, c_mktsegment, o_orderdate, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderkey % 4 + 1 AS n, o_orderkey % 9 + 1 AS k FROM orders JOIN customer ON c_custkey = o_custkey)))"""


def _sentences(spark, d):
    """A sentence for each order, of twenty kinds in turn, with the order's year and numbers from its key; a third begin with a company."""
    y, n, k = F.year("o_orderdate"), (c("o_orderkey") % 4 + 1).cast("int"), (c("o_orderkey") % 9 + 1).cast("int")
    yy, m = y % 100, F.greatest(n, F.lit(2))
    said = _by_key(
        F.format_string("%d년 %d분기 매출은 %d조 원이다.", y, n, k), "작년 상반기 이익이 늘었다.", F.format_string("%d분기 실적은 좋다.", n), "전년 동기 대비 올랐다.",
        "전분기보다 값이 낮았다.", F.format_string("%dH1과 %dQ%d.", y, y, n), "주가가 오를 것으로 전망된다.", "좋다.",
        F.format_string("%d년 1~%d분기 누적 이익이 줄었다.", y, m), F.format_string("%d년 3분기 매출은 2조, 전년 동기는 1조다.", y), F.format_string("%d년 상반기와 하반기 모두 흑자였다.", y), F.format_string("%dQ%02d 누적 매출은 %d년 대비 늘었다.", n, yy, y - 1),
        "재작년 값, 이번 분기 값", "하반기에 이익이 많이 늘었다", F.format_string("'%02d.%dQ 누계 매출", yy, n), F.format_string("직전 분기 대비 %d%% 늘었다.", n),
        F.format_string("영업이익률은 %d%%다.", k), F.format_string("매출은 전년 동기 대비 %d%% 늘었다.", k), F.format_string("제품 비중은 %d%%p 올랐다.", k), F.format_string("순이익은 %d%% 증가했다.", k),
    )
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_mktsegment").alias("seg")), "o_custkey")
    o = spread(o.select("o_orderkey", "o_custkey", "o_orderdate", "seg"), "o_orderkey")
    text = F.when(c("o_custkey") % 3 == 0, F.concat("seg", F.lit("는 "), said)).otherwise(said)
    return o.select("o_orderkey", text.alias("text"), F.lit("BUILDING").alias("company"), P.as_of_day(F.to_date("o_orderdate")).alias("as_of"))


def _dated(sentences):
    return sentences.withColumn("periods", P.periods(c("text"), c("as_of")))


def _mentioned(spark, d, texts):
    names = table(spark, d, "customer").select(c("c_mktsegment").alias("name"), c("c_mktsegment").alias("company")).distinct()
    return companies.mentions(texts.select("o_orderkey", "text", "company"), names, "o_orderkey")


_BARE = "CASE WHEN {0} > aq THEN ay - 1 ELSE ay END"
_LABELS = _case(
    "y || 'Q' || n", "(ay - 1) || 'H1'", f"{_BARE.format('n')} || 'Q' || n", "''", "''", "y || 'H1,' || y || 'Q' || n", "''", "''",
    "y || 'Q' || m", "y || 'Q3,' || (y - 1) || 'Q3'", "y || 'H1,' || y || 'H2'", "yy || 'Q' || n", "(ay - 2) || ',' || ay || 'Q' || aq", f"{_BARE.format('4')} || 'H2'", "yy || 'Q' || n", "''", "''", "''", "''", "''",
)
_CUMULATIVE = _case(*["false"] * 8, "true", "false", "false", "n > 1", "false", "false", "n > 1", *["false"] * 5)
_SHIFTED = _case("false", "false", "n > aq", *["false"] * 10, "aq < 4", *["false"] * 6)
_RELATIVE = _case("false", "true", "true", *["false"] * 9, "true", "true", *["false"] * 6)


@query("fc12_period_mentions", f"WITH {_O} SELECT o_orderkey, {_LABELS} AS labels, {_CUMULATIVE} AS cumulative, {_SHIFTED} AS shifted, {_RELATIVE} AS relative FROM o")
def fc12(spark, d):
    """Periods of each sentence: bases of comparison are none, quarters without year are read from the day."""
    has = lambda f: F.exists("periods", lambda p: p[f]).alias(f)
    return _dated(_sentences(spark, d)).select("o_orderkey", F.array_join(F.transform("periods", lambda p: p["label"]), ",").alias("labels"), has("cumulative"), has("shifted"), has("relative"))


@query("fc14_search_periods", """WITH o AS (SELECT o_orderkey, last_day(make_date(year(o_orderdate), 3 * (o_orderkey % 4 + 1)::INT, 1)) AS low FROM orders),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN low ELSE DATE '2001-07-01' END AS low, CASE WHEN o_orderkey % 2 = 0 THEN last_day((low + INTERVAL 2 YEAR)::DATE) ELSE DATE '2002-06-30' END AS high FROM o),
r AS (SELECT o_orderkey, last_day(make_date(y, 3 * n, 1)) AS e, y || suffix AS label, low, high FROM s, unnest(generate_series(1992, 2006)) t(y), (VALUES (1, 'Q1'), (2, 'Q2'), (3, 'Q3'), (4, 'Q4'), (2, 'H1'), (4, '')) v(n, suffix))
SELECT o_orderkey, string_agg(label, ',' ORDER BY e, label) AS labels FROM r WHERE e BETWEEN low AND high GROUP BY 1""")
def fc14(spark, d):
    """Reports in which a sentence's period may be found, up to two years later; without a period those of a year before the day."""
    n = (c("o_orderkey") % 4 + 1).cast("int")
    text = F.when(c("o_orderkey") % 2 == 0, F.format_string("%d년 %d분기 매출은 늘었다.", F.year("o_orderdate"), n)).otherwise("매출은 늘었다.")
    day = P.as_of_label(F.lit("2002H1"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(K.search_periods(P.periods(text, day), day), ",").alias("labels"))


@query("fc17_derived_kinds", f"SELECT o_orderkey, {_case(*['NULL'] * 15, *map(repr, ('growth', 'margin', 'growth', 'other', 'growth')))} AS kind FROM orders")
def fc17(spark, d):
    return _sentences(spark, d).select("o_orderkey", K.derived_kind(c("text")).alias("kind"))


_LATE = "CASE WHEN y * 4 + {0} > ay * 4 + aq THEN 'future_period' END"
_SCOPE = _case(_LATE.format("n"), *["NULL"] * 4, _LATE.format("greatest(2, n)"), "'market'", "NULL", _LATE.format("m"), _LATE.format("3"), _LATE.format("4"), "CASE WHEN yy * 4 + n > ay * 4 + aq THEN 'future_period' END", "NULL", "NULL", "CASE WHEN yy * 4 + n > ay * 4 + aq THEN 'future_period' END", "'derived:growth_unsupported'", "'derived:margin'", "'derived:growth'", "'derived:other'", "'derived:growth_unsupported'")


@query("fc20_scope", f"WITH {_O}, s AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND seg <> 'BUILDING' THEN 'other_company:' || seg ELSE {_SCOPE} END AS reason FROM o) SELECT o_orderkey, CASE WHEN starts_with(reason, 'other') THEN 'other_company' WHEN reason IN ('market', 'future_period') THEN 'out_of_scope' WHEN reason IN ('derived:growth_unsupported', 'derived:other') THEN 'derived' ELSE 'checked' END AS category, reason FROM s")
def fc20(spark, d):
    """Scope by subject, words and periods: a sentence about another company comes first."""
    s = _sentences(spark, d)
    other = companies.subjects(_mentioned(spark, d, s), "o_orderkey").select("o_orderkey", "other")
    joined = _dated(s.join(other, "o_orderkey", "left"))
    return joined.select("o_orderkey", K.scope(c("text"), c("other"), c("periods"), c("as_of")).alias("s")).select("o_orderkey", "s.*")


_WHY = _case("'number'", "'period'", "'number'", "'no_fact'", "'no_fact'", "'number'", "'market'", "'not_claim:short'", *["'number'"] * 4, "'period'", "'period'", *["'number'"] * 6)


@query("fc21_triage", f"WITH s AS (SELECT o_orderkey, {_WHY} AS why, o_custkey % 3 = 0 AS named FROM orders), r AS (SELECT o_orderkey, CASE WHEN named AND why <> 'number' THEN 'company' ELSE why END AS reason FROM s) SELECT o_orderkey, reason IN ('number', 'company', 'period') AS \"check\", reason FROM r")
def fc21(spark, d):
    """Whether each sentence is checked: by numbers, companies and periods that it names."""
    s = _sentences(spark, d)
    found = _mentioned(spark, d, s).select("o_orderkey", F.lit(True).alias("named")).distinct()
    joined = _dated(s.join(found, "o_orderkey", "left")).withColumn("named", F.coalesce("named", F.lit(False)))
    return joined.select("o_orderkey", K.triage(c("text"), c("named"), F.size("periods") > 0).alias("t")).select("o_orderkey", "t.*")


@query("fc22_probability_triage", f"WITH {CLAIMS} SELECT run_id, idx, part, latency_ms, s + c >= 0.8::DOUBLE AS skipped, CASE WHEN s + c >= 0.8::DOUBLE THEN CASE WHEN s >= c THEN 'opinion' ELSE 'market' END ELSE 'checked' END AS category FROM claims")
def fc22(spark, d):
    skip = c("s") + c("c") >= 0.8
    return claims(spark, d).select("run_id", "idx", "part", "latency_ms", skip.alias("skipped"), F.when(skip, F.when(c("s") >= c("c"), "opinion").otherwise("market")).otherwise("checked").alias("category"))


_SAID = "o AS (SELECT o_orderkey, o_orderkey % 4 + 1 AS n, o_orderkey % 9 + 1 AS k FROM orders)"
_CLAIMED = """n AS (SELECT o_orderkey, unnest(CASE o_orderkey % 8 WHEN 0 THEN [{'a': 'revenue', 'v': k * 1e12, 'p': false}] WHEN 1 THEN [{'a': 'revenue', 'v': k * 1e12, 'p': false}, {'a': 'operating_income', 'v': n * 1e8, 'p': false}]
  WHEN 2 THEN [{'a': 'operating_income', 'v': k * 1e12, 'p': false}] WHEN 3 THEN [{'a': 'operating_income', 'v': -n * 1e8, 'p': true}] WHEN 4 THEN [{'a': 'operating_margin', 'v': n + 0.5::DOUBLE, 'p': false}, {'a': 'revenue', 'v': k * 1e8, 'p': false}]
  WHEN 6 THEN [{'a': 'net_income', 'v': -n * 1e8, 'p': false}] ELSE [] END) AS x FROM o)"""


@query("fc23_amount_claims", f"WITH {_SAID}, {_CLAIMED} SELECT o_orderkey, x.a AS account, x.v::DOUBLE AS value, x.p AS approximate FROM n")
def fc23(spark, d):
    """Claims of eight kinds in turn: single, groups of accounts, from A to B, losses, about, margins, groups that don't fit, none."""
    n, k = (c("o_orderkey") % 4 + 1).cast("int"), (c("o_orderkey") % 9 + 1).cast("int")
    said = _by_key(
        F.format_string("매출은 %d조 원이다.", k), F.format_string("매출과 영업이익은 각각 %d조 원, %d억 원이다.", k, n), F.format_string("영업이익은 %d억 원에서 %d조 원으로 늘었다.", n, k), F.format_string("영업손실은 약 %d억 원이다.", n),
        F.format_string("영업이익률은 %d.5%%이고 매출은 %d억 원이다.", n, k), F.format_string("매출, 영업이익과 순이익은 %d조 원, %d억 원이다.", k, n), F.format_string("순이익은 △%d억 원으로 2024년 %d분기보다 낮다.", n, n), "매출은 올랐다.",
    )
    each = table(spark, d, "orders").select("o_orderkey", F.explode(K.amount_claims(said)).alias("n"))
    return each.select("o_orderkey", "n.account", c("n.value").cast("double").alias("value"), "n.approximate")


@query("fc24_candidate_facts", f"WITH {FACTS} SELECT company, year, arg_max(amount, row(n % 2 = 0, quarter)) AS amount FROM facts GROUP BY 1, 2")
def fc24(spark, d):
    """A final fact comes before a preliminary one, then the later quarter."""
    return facts(spark, d).groupBy("company", "year").agg(F.max_by("amount", F.struct(c("n") % 2 == 0, "quarter")).alias("amount"))


def _claimed(spark, d):
    """A claim for each fact: cut at a million, or wrong, or approximate to its first digit."""
    f = facts(spark, d).withColumn("k", (c("company") + c("quarter")) % 3)
    big = c("amount").cast("decimal(38,6)")
    first = F.pow(F.lit(10), F.length(c("amount").cast("string")) - 1).cast("decimal(20,0)")
    step = F.when(c("k") == 2, first).otherwise(F.lit(1_000_000)).cast("decimal(38,6)")
    value = F.when(c("k") == 1, big - big % step + 2 * step).when(c("k") == 2, F.round(big / first).cast("decimal(38,6)") * first).otherwise(big - big % step)
    return f.select("company", "year", "quarter", "k", "amount", step.alias("step"), value.cast("decimal(38,6)").alias("claim"))


@query("fc25_amount_equality", f"WITH {FACTS} SELECT company, year, quarter, CASE (company + quarter) % 3 WHEN 0 THEN amount >= 1000000 WHEN 1 THEN false ELSE true END AS same FROM facts WHERE amount >= 10000000")
def fc25(spark, d):
    """Approximate claims round at their first digit, so they match by rounding alone."""
    m = _claimed(spark, d).where("amount >= 10000000")
    return m.select("company", "year", "quarter", X.same_amount(c("claim"), c("step"), c("amount").cast("decimal(38,6)"), c("k") == 2, F.lit(1).cast("decimal(38,6)")).alias("same"))


@query("fc26_margin", f"WITH {FACTS} SELECT company, year, round(100.0 * sum(amount) FILTER (quarter = 1) / sum(amount), 4) AS margin, CASE WHEN count(*) < 4 THEN 'partial' ELSE 'full' END AS note FROM facts GROUP BY 1, 2")
def fc26(spark, d):
    part = F.sum(F.when(c("quarter") == 1, c("amount")))
    return facts(spark, d).groupBy("company", "year").agg(F.round(100.0 * part / F.sum("amount"), 4).alias("margin"), F.when(F.count("*") < 4, "partial").otherwise("full").alias("note"))


@query("fc28_sentence_verdict", f"WITH {CLAIMS} SELECT run_id, CASE WHEN count(*) FILTER (status = 'contradicted') > 0 THEN 'mismatch' WHEN count(*) FILTER (status = 'supported') = count(*) THEN 'match' WHEN count(*) FILTER (status = 'supported') > 0 THEN 'partial' ELSE 'unknown' END AS status FROM claims GROUP BY 1")
def fc28(spark, d):
    result = F.when(c("status") == "contradicted", "mismatch").when(c("status") == "supported", "match").otherwise("unknown")
    return X.verdict(claims(spark, d).select("run_id", result.alias("result")), "run_id")


@query("fc30_inherited_period", """WITH t AS (SELECT conv_id, turn, turn % 4 AS kind, 2020 + conv_id % 5 || 'Q' || (turn // 4 % 4 + 1) AS label, CASE turn % 5 WHEN 0 THEN ['a'] WHEN 2 THEN ['b'] WHEN 3 THEN ['a', 'b'] ELSE [] END AS subjects FROM conversations),
b AS (SELECT *, last_value(CASE WHEN kind = 0 THEN label END IGNORE NULLS) OVER w AS before, last_value(CASE WHEN turn % 2 = 0 AND len(subjects) > 0 THEN subjects END IGNORE NULLS) OVER w AS anchor FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, CASE WHEN kind = 1 THEN before END AS period, CASE WHEN len(subjects) > 0 OR anchor IS NULL OR anchor = ['a'] THEN NULL WHEN list_contains(anchor, 'a') THEN 'ambiguous' ELSE 'other' END AS note FROM b""")
def fc30(spark, d):
    """Turns as sentences that lean on those before: a period of the unit asked for, and the company of the last that set one."""
    text = F.element_at(F.array(F.format_string("%d년 %d분기 매출은 늘었다.", c("conv_id") % 5 + 2020, F.floor(c("turn") / 4) % 4 + 1), F.lit("같은 분기 이익도 늘었다."), F.lit("같은 해 값은 낮다."), F.lit("좋은 값이다.")), (c("turn") % 4 + 1).cast("int"))
    who = F.when(c("turn") % 5 == 0, F.array(F.lit("a"))).when(c("turn") % 5 == 2, F.array(F.lit("b"))).when(c("turn") % 5 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    t = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"), who.alias("subjects"), F.lit("a").alias("own"), (c("turn") % 2 == 0).alias("anchor"))
    t = t.withColumn("periods", P.periods(c("text"), P.as_of_label(F.lit("2030"))))
    return K.inherited(t, "conv_id", "turn").select("conv_id", "turn", c("period.label").alias("period"), c("company_note").alias("note"))


@query("fc31_evidence_lines", f"WITH {FACTS} SELECT company, string_agg(year || 'Q' || quarter || '=' || amount, '; ' ORDER BY year, quarter) AS line FROM facts GROUP BY 1")
def fc31(spark, d):
    line = F.format_string("%dQ%d=%d", "year", "quarter", "amount")
    rows = F.sort_array(F.collect_list(F.struct("year", "quarter", line.alias("line"))))
    return facts(spark, d).groupBy("company").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "; ").alias("line"))


def _reported(spark, d):
    """Filed revenue of each company's quarters, even companies consolidated, odd ones separate: of first quarters a restated
    value too, of second quarters a superseded one."""
    f = facts(spark, d)
    day = _spanned(f)
    base = day.select("company", F.lit("revenue").alias("account"), F.when(c("company") % 2 == 0, "CFS").otherwise("OFS").alias("statement"), "first", "last", c("amount").cast("decimal(28,0)").alias("amount"), F.lit(1).alias("rounding_unit"), F.lit(True).alias("final"), F.lit(True).alias("current"), F.lit("a").alias("filed"), F.lit(False).alias("corrected"), F.lit(False).alias("superseded"), "quarter")
    restated = base.where("quarter = 1").withColumns({"amount": (c("amount") + 1_000_000_000).cast("decimal(28,0)"), "current": F.lit(False), "filed": F.lit("b")})
    old = base.where("quarter = 2").withColumns({"amount": (c("amount") * 2).cast("decimal(28,0)"), "superseded": F.lit(True), "filed": F.lit("z")})
    return base.union(restated).union(old).drop("quarter")


def _spanned(f):
    start = F.make_date("year", c("quarter") * 3 - 2, F.lit(1))
    return f.withColumns({"first": start, "last": F.last_day(F.add_months(start, 2))})


def _report_sentences(spark, d):
    """A sentence for each company's quarter, from the quarter before where it is known; of every third one the first amount is wrong."""
    f = facts(spark, d)
    before = f.select("company", (c("year") * 4 + c("quarter") + 1).alias("at"), c("amount").alias("was"))
    g = f.withColumn("at", c("year") * 4 + c("quarter")).join(before, ["company", "at"], "left").withColumn("k", (c("company") + c("quarter")) % 3)
    won = lambda x: F.concat(F.format_number(x, 0), F.lit("원"))
    head = F.format_string("%d년 %d분기 매출은 ", "year", "quarter")
    text = F.when(c("was").isNull(), F.concat(head, won(c("amount")), F.lit("이다."))).otherwise(F.concat(head, F.lit("전 분기 "), won(c("was") + F.when(c("k") == 1, 5).otherwise(0)), F.lit("에서 "), won(c("amount")), F.lit("으로 늘었다.")))
    return g.select("company", "year", "quarter", F.concat_ws("-", "company", "year", "quarter").alias("key"), "k", "was", text.alias("text"))


def _claims_of(sentences):
    each = sentences.select("key", "company", F.posexplode(K.dated_claims(c("text"), P.as_of_label(F.lit("2030")))).alias("idx", "x")).select("key", "company", "idx", "x.*")
    return K.spans_of(each)


_PAIRS_SQL = """g AS (SELECT f.*, b.amount AS was, (f.company + f.quarter) % 3 = 1 AND b.amount IS NOT NULL AS wrong, CASE WHEN f.quarter = 1 THEN 4 ELSE f.quarter - 1 END AS bq FROM facts f LEFT JOIN facts b ON b.company = f.company AND b.year * 4 + b.quarter + 1 = f.year * 4 + f.quarter)"""


@query("fc27_claim_periods", f"""WITH {FACTS}, {_PAIRS_SQL},
c AS (SELECT company || '-' || year || '-' || quarter AS key, 0 AS idx, company, CASE WHEN wrong THEN 'mismatch' ELSE 'match' END AS status, was AS amount, bq AS q, wrong FROM g WHERE was IS NOT NULL
  UNION ALL SELECT company || '-' || year || '-' || quarter, CASE WHEN was IS NULL THEN 0 ELSE 1 END, company, 'match', amount, quarter, wrong FROM g)
SELECT key, idx, status, CASE WHEN company % 2 = 0 THEN 'CFS' ELSE 'OFS' END AS statement, amount, nullif(concat_ws(',', CASE WHEN company % 2 = 1 AND NOT wrong THEN 'separate_only' END, CASE WHEN q = 1 THEN 'restated_exists' END), '') AS note FROM c""")
def fc27(spark, d):
    """Each amount is compared in the period it is claimed for: the first of `from A to B` in the quarter before the second's."""
    found = K.evaluated(_claims_of(_report_sentences(spark, d)), _reported(spark, d), "key")
    return found.withColumn("note", F.when(c("note") != "", c("note")))


@query("fc32_sentence_cascade", f"""WITH {FACTS}, {_PAIRS_SQL} SELECT company || '-' || year || '-' || quarter AS key, CASE (company + year) % 4 WHEN 1 THEN 'out_of_scope' WHEN 2 THEN 'skipped' ELSE CASE WHEN wrong THEN 'mismatch' ELSE 'match' END END AS status FROM g""")
def fc32(spark, d):
    """From sentence to verdict: rules skip it or put it out of scope, else its amounts are compared with what was filed."""
    day = P.as_of_label(F.lit("2030"))
    s = _report_sentences(spark, d)
    turn = (c("company") + c("year")) % 4
    s = s.withColumn("text", F.when(turn == 1, F.concat("text", F.lit(" 더 늘 것으로 예상된다."))).when(turn == 2, F.lit("매출은 얼마일까?")).otherwise(c("text"))).withColumn("periods", P.periods(c("text"), day))
    s = s.withColumn("checked", K.triage(c("text"), F.lit(False), F.size("periods") > 0)["check"]).withColumn("category", K.scope(c("text"), F.lit(None).cast("string"), c("periods"), day)["category"])
    open_ = s.where("checked and category = 'checked'")
    results = K.evaluated(_claims_of(open_), _reported(spark, d), "key")
    verdicts = X.verdict(results.withColumnRenamed("status", "result"), "key")
    status = F.when(~c("checked"), "skipped").when(c("category") != "checked", c("category")).otherwise(F.coalesce("status", F.lit("unknown")))
    return s.join(verdicts, "key", "left").select("key", status.alias("status"))


@query("fc29_support_gate", f"""WITH {FACTS}, {_PAIRS_SQL} SELECT company || '-' || year || '-' || quarter AS key, NOT wrong AND was IS NULL AND company % 2 = 0 AS supported FROM g""")
def fc29(spark, d):
    """Supported without a judge: every amount equals a filed one, has two digits or more, and no word but of accounts and amounts is left."""
    s = _report_sentences(spark, d)
    s = s.withColumn("text", F.when(c("company") % 2 == 1, F.concat(F.lit("아마 "), "text")).otherwise(c("text")))
    claimed = _claims_of(s)
    results = K.evaluated(claimed, _reported(spark, d), "key").join(claimed.select("key", "idx", "value", "step"), ["key", "idx"])
    digits = F.length((F.abs("value") / c("step")).cast("decimal(38,0)").cast("string"))
    whole = results.groupBy("key").agg(F.bool_and(c("status") == "match").alias("same"), F.min(digits).alias("digits"))
    return s.join(whole, "key", "left").select("key", K.supported(c("same"), c("digits"), K.unread(c("text"))).alias("supported"))


@query("fc33_company_keys", "SELECT s_suppkey, 'SUPPLIER#' || lpad(s_suppkey::VARCHAR, 9, '0') AS k FROM supplier")
def fc33(spark, d):
    name = F.element_at(F.array(F.concat(F.lit("(주) "), "s_name"), F.concat("s_name", F.lit(" Co., Ltd.")), F.concat(F.lit("주식회사 "), "s_name")), (c("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", companies.company_key(name).alias("k"))


def _reserved_sql(key: str, amount: str, key_cap: int, total_cap: int) -> str:
    """Events of a day one after another, with what every key and all together have used."""
    return f"""WITH RECURSIVE e AS (SELECT ts::DATE AS day, event_id, {key} AS k, ({amount})::BIGINT AS amount, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT day, 0::BIGINT AS rn, 0::BIGINT AS total, MAP([''], [0::BIGINT]) AS used, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted FROM (SELECT DISTINCT day FROM e)
  UNION ALL SELECT day, rn, CASE WHEN ok THEN total + amount ELSE total END, CASE WHEN ok THEN map_concat(used, MAP([k], [mine + amount])) ELSE used END, event_id, ok FROM (
    SELECT *, mine + amount <= {key_cap} AND total + amount <= {total_cap} AS ok FROM (SELECT r.day, e.rn, r.total, r.used, e.event_id, e.k, e.amount, coalesce(list_extract(map_extract(r.used, e.k), 1), 0) AS mine FROM r JOIN e ON e.day = r.day AND e.rn = r.rn + 1)))
SELECT event_id, accepted FROM r WHERE rn > 0"""


@query("fc34_reservations", _reserved_sql("user_id::VARCHAR", "user_id % 7 + 1", 8, 900))
def fc34(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), c("ts").alias("at"), c("event_id").alias("tie"), c("user_id").cast("string").alias("key"), (c("user_id") % 7 + 1).cast("long").alias("amount"))
    return X.reserve(e, 8, 900).select(c("tie").alias("event_id"), "accepted")


@query("fc35_stale_reservations", "SELECT user_id, count(*) AS stale, sum(user_id % 7 + 1)::BIGINT AS settled FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 15 MINUTE AND event_type = 'view' GROUP BY 1")
def fc35(spark, d):
    old = table(spark, d, "events").where(F.expr("ts < timestamp_ntz '2024-01-20' - interval 15 minutes and event_type = 'view'"))
    return old.groupBy("user_id").agg(F.count("*").alias("stale"), F.sum(c("user_id") % 7 + 1).alias("settled"))


@query("fc36_call_charges", f"WITH {CLAIMS} SELECT route, sum(CASE WHEN status = 'no_evidence' THEN 0 WHEN status = 'contradicted' THEN latency_ms ELSE latency_ms * 2 END)::BIGINT AS charged FROM claims GROUP BY 1")
def fc36(spark, d):
    """Failed calls cost nothing, calls with recorded usage that, others the estimate."""
    cost = F.when(c("status") == "no_evidence", 0).when(c("status") == "contradicted", c("latency_ms")).otherwise(c("latency_ms") * 2)
    return claims(spark, d).groupBy("route").agg(F.sum(cost).alias("charged"))


@query("fc37_daily_keys", "SELECT event_id, sha256('salt' || strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') || user_id) AS k FROM events")
def fc37(spark, d):
    day = F.date_format(c("ts") + F.expr("INTERVAL 9 HOURS"), "yyyyMMdd")
    return table(spark, d, "events").select("event_id", F.sha2(F.concat(F.lit("salt"), day, "user_id"), 256).alias("k"))


@query("fc38_admission", f"SELECT ts::DATE AS day, count(*) FILTER (accepted) AS admitted, count(*) AS asked FROM ({_reserved_sql(repr('all'), 'round(value)', 4_000, 4_000)}) JOIN events USING (event_id) GROUP BY 1")
def fc38(spark, d):
    """Jobs of a day admitted while their number and characters stay within the limits."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), c("ts").alias("at"), c("event_id").alias("tie"), F.lit("all").alias("key"), F.round("value").cast("long").alias("amount"))
    return X.reserve(e, 4_000, 4_000).groupBy("day").agg(F.count_if("accepted").alias("admitted"), F.count("*").alias("asked"))
