"""TX: sentences, chunks, lexical and number checks, decisions; JON10 and JON16."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators import companies, subjects
from tidewell.operators import passages as P
from tidewell.operators import text as X
from tidewell.operators.markup import spread
from tidewell.sources.views import CLAIMS, RUNS, claims, runs, table

c = F.col
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def _filings(spark, d):
    """Documents dressed as filings: the text as paragraphs of the second section; without a text it has none, and its length no figure."""
    docs = table(spark, d, "documents")
    body = F.coalesce(F.regexp_replace(F.regexp_replace("text", "[<>]", " "), r"\n+", "</P><P>"), F.lit(""))
    xml = F.concat(F.lit("<SECTION-1><TITLE>I. One</TITLE><P>first</P><SECTION-1><TITLE> Ⅱ. Two </TITLE><P>"), body, F.lit("</P><TITLE>Figures</TITLE><TABLE><TR><TD>By kind</TD><TD>(단위: 백만원)</TD></TR></TABLE><TABLE><TR><TH>name</TH><TH>amount</TH></TR><TR><TD>first<TD>"), "doc_id", F.lit("</TR><TR><TD>second</TD><TD>"), F.coalesce(F.length("text").cast("string"), F.lit("")), F.lit("</TD></TR></TABLE></SECTION-1><SECTION-1><TITLE>III. Three</TITLE><P>last &amp; least</P><SECTION-2><TITLE>3. 주석</TITLE><P>a note</P></SECTION-1>"))
    return docs.select("doc_id", "text", xml.alias("xml"))


@query("tx01_filing_section")
def tx01(spark, d):
    return P.filing_passages(_filings(spark, d), "II.Two").groupBy("doc_id").agg(F.count("*").alias("passages"), F.max(F.length("text")).alias("longest"))


@query("tx03_packed_passages")
def tx03(spark, d):
    return P.filing_passages(_filings(spark, d), "II.Two").select("doc_id", "idx", "text")


@query("tx04_passage_ids", "SELECT doc_id, 'd-' || lpad(i::VARCHAR, 4, '0') AS id, sha256(l) AS sha FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def tx04(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return each.select("doc_id", F.format_string("d-%04d", "i").alias("id"), F.sha2("l", 256).alias("sha"))


def _chunk_sql(size: int, overlap: int) -> str:
    return f"w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), ch AS (SELECT doc_id, s, array_to_string(ws[s + 1:s + {size}], ' ') AS chunk FROM w, unnest(range(0, greatest(len(ws) - 1 - {overlap}, 0) + 1, {size - overlap})) r(s) WHERE len(ws) > 0)"


@query("tx05_chunks", f"WITH {_chunk_sql(800, 100)} SELECT doc_id, count(*) AS n, sum(length(chunk))::BIGINT AS chars, sha256(string_agg(chunk, '|' ORDER BY s)) AS digest FROM ch GROUP BY 1")
def tx05(spark, d):
    made = table(spark, d, "documents").select("doc_id", X.chunks(c("text"), 800, 100).alias("ch")).where(F.size("ch") > 0)
    return made.select("doc_id", F.size("ch").cast("long").alias("n"), F.aggregate("ch", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.sha2(F.array_join("ch", "|"), 256).alias("digest"))




@query("tx06_sentence_groups", "WITH l AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) SELECT conv_id, k // 10 AS chunk, string_agg(role, ' ' ORDER BY turn) AS text FROM l GROUP BY 1, 2")
def tx06(spark, d):
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("sentences"))
    return X.grouped_sentences(lists, "conv_id")


_SENTENCES = r"""li AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS l, generate_subscripts(regexp_split_to_array(text, '\r\n|\n|\r'), 1) AS i FROM documents),
pt AS (SELECT doc_id, i, string_split(regexp_replace(regexp_replace(l, '^\s*(?:[-*•·]|\d+[.)])\s*', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM li),
sn AS (SELECT doc_id, i, unnest(ps) AS p, generate_subscripts(ps, 1) AS j FROM pt), st AS (SELECT doc_id, i, j, regexp_replace(p, '^\s+|\s+$', '', 'g') AS sentence FROM sn)"""


@query("tx07_sentences", f"WITH {_SENTENCES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS idx, sentence FROM st WHERE length(sentence) >= 4")
def tx07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(c("text"))).alias("idx", "sentence"))


@query("tx08_sentence_spans")
def tx08(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(X.spans(X.sentences(c("text")), c("text"))).alias("s")).select("item_id", "s.*")


@query("tx09_no_claim", "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'question' WHEN 1 THEN 'phrase' WHEN 2 THEN 'lead' WHEN 3 THEN 'short' WHEN 6 THEN 'lead' END AS reason FROM orders")
def tx09(spark, d):
    """Sentences of nine kinds in turn, some with a number of the order they stand for."""
    n = c("o_orderkey")
    said = (F.format_string("매출이 %d원 늘었나요?", n), "문단에 그 값이 없습니다.", "주요 사업은 다음과 같습니다.", "좋다.", "삼성은 성장했다.", F.format_string("매출은 %d조 원입니다.", n), "요약:", F.format_string("%d건:", n), "Good. ")
    rows = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in said)), (n % len(said) + 1).cast("int")).alias("s"))
    return rows.select("o_orderkey", X.no_claim(c("s")).alias("reason"))


_BG = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_PAIRS = f"""li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), sq AS (SELECT doc_id, line, regexp_replace(t, '\\s+', '', 'g') AS t FROM li),
bg AS (SELECT doc_id, line, {_BG.format('t')} AS b FROM sq), pr AS (SELECT q.doc_id, p.line, round(coalesce(len(list_intersect(q.b, p.b)) / nullif(len(q.b), 0), 0), 8) AS score FROM bg q JOIN bg p USING (doc_id) WHERE q.line = 0 AND p.line > 0)"""


@query("tx10_bigrams", f"SELECT item_id, len({_BG.format('t')}) AS n FROM (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark)")
def tx10(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(X.bigrams(c("text"))).alias("n"))


def _pairs(spark, d):
    """Each document's first line as a claim, with the document's other lines as its passages: a claim meets its own ones only."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.split("text", "\n").alias("lines"))
    # The claim's bigrams are taken once a document and meet its lines there: nothing is joined, and they are not copied to each line.
    rest = F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))
    each = docs.select("doc_id", F.posexplode(X.recalls(c("lines")[0], rest)).alias("at", "score"))
    return each.select("doc_id", (c("at") + 1).alias("line"), F.round("score", 8).alias("score"))


@query("tx11_lexical_best", f"WITH {_PAIRS}, top AS (SELECT doc_id, max(score) AS score, arg_max(line, row(score, -line)) AS best FROM pr GROUP BY 1) SELECT doc_id, score, CASE WHEN score > 0 THEN best END AS best FROM top")
def tx11(spark, d):
    return X.lexical_best(_pairs(spark, d), "doc_id", "line", "score")


@query("jon10_claim_passages", f"WITH {_PAIRS} SELECT * FROM pr WHERE score > 0.5")
def jon10(spark, d):
    return _pairs(spark, d).where("score > 0.5")


def _amounts(spark, d):
    """Claims and passages with numbers from each order, of six kinds in turn."""
    k, m = c("o_orderkey").cast("bigint"), F.floor("o_totalprice").cast("bigint")
    tens = (m / 10).cast("bigint")
    kinds = (
        (F.format_string("%d조 %,d억 원", k % 9 + 1, m % 10000), F.format_string("매출 %,d백만", (k % 9 + 1) * 1_000_000 + m % 10000 * 100)), (F.format_string("%d.%d%%", k % 100, m % 10), F.format_string("[표 단위 백만원] %d.%d4 %%", k % 100, m % 10)),
        (F.format_string("%d.5%%p", k % 100), F.format_string("%d.5%% 상승", k % 100)), (F.format_string("(%,d)", m), F.format_string("%,d", m)),
        (F.format_string("%d억원", tens), F.format_string("[매출 표 | 단위 천만원] %,d", m)), (F.format_string("2025.12.31 %d천%d만원", k % 9 + 1, m % 1000), F.format_string("%d만 원", (k % 9 + 1) * 1000 + m % 1000)),
    )
    said = F.element_at(F.array(*(F.struct(a.alias("claim"), b.alias("passage")) for a, b in kinds)), (k % len(kinds) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", said.alias("s")).select("o_orderkey", "s.*")


_AMOUNTS = "o AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderkey % 9 + 1 AS u, o_orderkey % 100 AS p, floor(o_totalprice)::BIGINT AS m FROM orders)"
_CLAIMED = f"""{_AMOUNTS}, n AS (SELECT o_orderkey, unnest(CASE kind WHEN 0 THEN [(u * 1000000000000 + m % 10000 * 100000000)::DOUBLE] WHEN 1 THEN [(p + m % 10 / 10.0)::DOUBLE] WHEN 2 THEN [(p + 0.5)::DOUBLE]
  WHEN 3 THEN [-m::DOUBLE] WHEN 4 THEN [(m // 10 * 100000000)::DOUBLE] ELSE [2025::DOUBLE, 12::DOUBLE, 31::DOUBLE, ((u * 1000 + m % 1000) * 10000)::DOUBLE] END) AS value,
  CASE kind WHEN 1 THEN 'pct' WHEN 2 THEN 'pctp' ELSE 'abs' END AS kind FROM o)"""


@query("tx12_numbers", f"WITH {_CLAIMED} SELECT * FROM n")
def tx12(spark, d):
    return _amounts(spark, d).select("o_orderkey", F.explode(X.parse_numbers("claim")).alias("n")).select("o_orderkey", c("n.value").cast("double").alias("value"), "n.kind")


@query(
    "tx13_passage_numbers",
    f"""WITH {_AMOUNTS}, n AS (SELECT o_orderkey, unnest(CASE kind WHEN 0 THEN [{{'v': (u * 1000000 + m % 10000 * 100) * 1000000::DOUBLE, 'k': 'abs'}}]
  WHEN 1 THEN [{{'v': (p + m % 10 / 10.0 + 0.04)::DOUBLE, 'k': 'pct'}}, {{'v': (p + m % 10 / 10.0 + 0.04)::DOUBLE, 'k': 'pct'}}, {{'v': (p + m % 10 / 10.0 + 0.04)::DOUBLE, 'k': 'pct'}}] WHEN 2 THEN [{{'v': (p + 0.5)::DOUBLE, 'k': 'pct'}}] WHEN 3 THEN [{{'v': m::DOUBLE, 'k': 'abs'}}]
  WHEN 4 THEN [{{'v': (m * 10000000)::DOUBLE, 'k': 'abs'}}, {{'v': m::DOUBLE, 'k': 'abs'}}] ELSE [{{'v': ((u * 1000 + m % 1000) * 10000)::DOUBLE, 'k': 'abs'}}] END) AS x FROM o)
SELECT o_orderkey, x.v AS value, x.k AS kind FROM n""",
)
def tx13(spark, d):
    return _amounts(spark, d).select("o_orderkey", F.explode(X.parse_passage_numbers("passage")).alias("n")).select("o_orderkey", c("n.value").cast("double").alias("value"), "n.kind")


@query("tx14_same_value", "SELECT p_partkey, floor(p_retailprice / 10) * 10 = p_size * 20 OR round(p_retailprice / 10) * 10 = p_size * 20 AS same FROM part")
def tx14(spark, d):
    """Prices against a rounded claim with a last digit of ten."""
    num = lambda v, step: F.struct(v.cast("decimal(38,6)").alias("value"), F.lit(step).cast("decimal(38,6)").alias("step"), F.lit("abs").alias("kind"), F.lit("").alias("digits"))
    p = table(spark, d, "part").select("p_partkey", num(c("p_retailprice"), 1).alias("h"), num(c("p_size") * 20, 10).alias("w"))
    return p.select("p_partkey", X.same_number(c("h"), c("w")).alias("same"))


@query("tx15_number_check", f"WITH {_AMOUNTS} SELECT o_orderkey, kind IN (0, 1, 3, 4) AS ok FROM o")
def tx15(spark, d):
    """Equal when rounded or cut at the claim's last digit; points are no percent, and a date's numbers are wanted too."""
    parsed = _amounts(spark, d).select("o_orderkey", X.parse_numbers("claim").alias("w"), X.parse_passage_numbers("passage").alias("h"))
    return parsed.select("o_orderkey", X.numbers_agree(c("w"), c("h")).alias("ok"))


_NAMED = r"""f AS (SELECT doc_id, string_split(text, chr(10))[1] AS claim, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS passage FROM documents),
t AS (SELECT doc_id, passage, claim, unnest(regexp_split_to_array(claim, '\s+')) AS raw FROM f),
n AS (SELECT DISTINCT doc_id, passage, regexp_replace(raw, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS name FROM t WHERE regexp_matches(raw, '[A-Z]')
  UNION SELECT doc_id, passage, trim(unnest(regexp_extract_all(claim, '[''‘"“「『]([^''’"”」』]{2,})[''’"”」』]', 1))) FROM f)"""


@query("tx16_name_bounds", f"WITH {_NAMED}, h AS (SELECT doc_id, bool_and(regexp_matches(passage, '(^|[^가-힣A-Za-z0-9])' || regexp_escape(name) || '($|[^가-힣A-Za-z0-9])')) AS ok FROM n WHERE name <> '' GROUP BY 1) SELECT doc_id, coalesce(ok, true) AS found FROM f LEFT JOIN h USING (doc_id)")
def tx16(spark, d):
    """All names of a document's first line stand in the lines after it, at the bounds of words."""
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    rest = F.array_join(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), "\n")
    return lines.select("doc_id", subjects.names_in_passage(c("l")[0], rest, F.lit("")).alias("found"))


@query("tx17_tiers", f"WITH {CLAIMS} SELECT run_id, idx, part, CASE WHEN s < 0.2::DOUBLE THEN 'low' WHEN s >= 0.7::DOUBLE AND c < 0.4::DOUBLE THEN 'high' ELSE 'judge' END AS tier, latency_ms FROM claims")
def tx17(spark, d):
    return claims(spark, d).select("run_id", "idx", "part", X.tier(c("s"), c("c") < 0.4, 0.2, 0.7).alias("tier"), "latency_ms")


_LISTS = f"{CLAIMS}, li AS (SELECT run_id, list(s ORDER BY idx, part, s, c, latency_ms) AS ss, list(c ORDER BY idx, part, s, c, latency_ms) AS cs, list(route <> 'low' ORDER BY idx, part, s, c, latency_ms) AS vs FROM claims GROUP BY 1)"


def _lists(spark, d):
    """Each run's passage probabilities as arrays in order."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "part", "s", "c", "latency_ms", (c("route") != "low").alias("v"))))
    g = claims(spark, d).groupBy("run_id").agg(rows.alias("r"))
    return g.select("run_id", c("r.s").alias("s"), c("r.c").alias("c"), c("r.v").alias("v"))


@query("tx18_decision", f"""WITH {_LISTS}, b AS (SELECT *, list_max(cs) AS mc, list_max(list_transform(list_filter(list_zip(ss, vs, range(len(ss))), lambda z: z[2]), lambda z: {{'s': z[1], 'i': z[3]}})) AS best FROM li)
SELECT run_id, CASE WHEN mc >= 0.6::DOUBLE AND mc > coalesce(best.s, 0) THEN 'contradicted' WHEN best.s >= 0.5::DOUBLE THEN 'supported' ELSE 'no_evidence' END AS status,
  CASE WHEN mc >= 0.6::DOUBLE AND mc > coalesce(best.s, 0) THEN list_position(cs, mc) - 1 WHEN best.s >= 0.5::DOUBLE THEN best.i END::INT AS source,
  round(CASE WHEN mc >= 0.6::DOUBLE AND mc > coalesce(best.s, 0) THEN 0 ELSE coalesce(best.s, 0) END, 6) AS score FROM b""")
def tx18(spark, d):
    made = _lists(spark, d).select("run_id", X.decision(c("s"), c("c"), c("v"), F.lit(True), 0.5, 0.6).alias("x"))
    return made.select("run_id", "x.status", "x.source", F.round("x.score", 6).alias("score"))


@query("tx19_passage_labels", f"WITH {CLAIMS} SELECT run_id, idx, part, latency_ms, CASE WHEN s >= c AND s >= 1 - s - c THEN 'supports' WHEN c >= 1 - s - c THEN 'contradicts' ELSE 'says_nothing' END AS label FROM claims")
def tx19(spark, d):
    return claims(spark, d).select("run_id", "idx", "part", "latency_ms", X.passage_label(c("s"), c("c")).alias("label"))


@query("tx21_subject_decision", f"WITH {CLAIMS} SELECT run_id, max(s) FILTER (part % 3 = 0) AS subject_s, CASE WHEN count(*) FILTER (part % 3 = 0) = 0 THEN 'judge' WHEN max(s) FILTER (part % 3 = 0) >= 0.6::DOUBLE THEN 'supported' ELSE 'no_evidence' END AS status FROM claims GROUP BY 1")
def tx21(spark, d):
    """Only passages about the subject count; without any, the claim goes to the judge."""
    best = F.max(F.when(c("part") % 3 == 0, c("s")))
    return claims(spark, d).groupBy("run_id").agg(best.alias("subject_s"), F.when(best.isNull(), "judge").when(best >= 0.6, "supported").otherwise("no_evidence").alias("status"))


@query("tx22_follow_up", f"WITH {_LISTS} SELECT run_id, list_transform(ss, lambda x: x >= 0.6::DOUBLE)::VARCHAR AS mask, round(list_sum(list_filter(ss, lambda x: x >= 0.6::DOUBLE)), 6) AS signal FROM li WHERE len(ss) > 1")
def tx22(spark, d):
    li = _lists(spark, d).where(F.size("s") > 1)
    strong = F.filter("s", lambda x: x >= 0.6)
    mask = F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: (x >= 0.6).cast("string")), ", "), F.lit("]"))
    return li.select("run_id", mask.alias("mask"), F.round(F.when(F.size(strong) > 0, F.aggregate(strong, F.lit(0.0), lambda a, x: a + x)), 6).alias("signal"))


@query("tx23_personal", r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') OR regexp_matches(text, '(^|[^0-9])01[016789][-. \t\n]?[0-9]{3,4}[-. \t\n]?[0-9]{4}($|[^0-9])') OR regexp_matches(text, '(^|[^0-9])[0-9]{6}[ \t\n]?-[ \t\n]?[1-4][0-9]{6}($|[^0-9])') AS found FROM documents")
def tx23(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_personal(c("text")).alias("found"))


@query("tx24_run_status", f"WITH {CLAIMS}, {RUNS}, g AS (SELECT run_id, count(*) AS n, count(*) FILTER (idx <= 8 AND status <> 'no_evidence') AS done FROM claims GROUP BY 1) SELECT r.run_id, CASE WHEN r.user % 50 = 0 THEN 'skipped' WHEN n IS NULL THEN 'failed' WHEN n > 6 THEN 'limited' WHEN done = n THEN 'done' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status FROM runs r LEFT JOIN g USING (run_id)")
def tx24(spark, d):
    g = claims(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if((c("idx") <= 8) & (c("status") != "no_evidence")).alias("done"))
    status = F.when(c("user") % 50 == 0, "skipped").when(c("n").isNull(), "failed").when(c("n") > 6, "limited").when(c("done") == c("n"), "done").when(c("done") > 0, "partial").otherwise("failed")
    return runs(spark, d).join(g, "run_id", "left").select("run_id", status.alias("status"))


@query("tx25_rejudge", f"WITH {CLAIMS} SELECT run_id, idx, part, latency_ms, CASE WHEN s >= 0.7::DOUBLE THEN 'supported' WHEN c >= 0.7::DOUBLE THEN 'contradicted' WHEN route = 'judge' THEN 'needs_call' ELSE 'no_evidence' END AS status FROM claims")
def tx25(spark, d):
    s = F.when(c("s") >= 0.7, "supported").when(c("c") >= 0.7, "contradicted").when(c("route") == "judge", "needs_call").otherwise("no_evidence")
    return claims(spark, d).select("run_id", "idx", "part", "latency_ms", s.alias("status"))


@query("tx26_confidence", f"WITH {CLAIMS} SELECT run_id, idx, part, latency_ms, CASE WHEN s < 0.4::DOUBLE THEN NULL WHEN s >= 0.8::DOUBLE THEN 'high' WHEN s >= 0.6::DOUBLE THEN 'middle' ELSE 'low' END AS label FROM claims")
def tx26(spark, d):
    """Bands above the threshold, split at one and two thirds of the rest."""
    band = F.floor(F.round((c("s") - 0.4) / 0.2, 9)).cast("int")
    label = F.when(c("s") >= 0.4, F.element_at(F.array(*map(F.lit, ("low", "middle", "high"))), F.least(band, F.lit(2)) + 1))
    return claims(spark, d).select("run_id", "idx", "part", "latency_ms", label.alias("label"))


@query("tx27_queue", f"WITH {RUNS}, p AS (SELECT * FROM runs WHERE status = 'running' AND started >= TIMESTAMP '2001-01-01') SELECT run_id, started < TIMESTAMP '2001-07-01' - INTERVAL 60 SECOND AS stale, row_number() OVER (ORDER BY started, run_id) - 1 AS ahead FROM p")
def tx27(spark, d):
    """Runs that wait: whether they are stale, and how many wait before them."""
    p = runs(spark, d).where("status = 'running' and started >= '2001-01-01'").withColumn("day", F.to_date("started"))
    # Only the days' counts are summed in one place; places within a day are the day's own.
    days = p.groupBy("day").agg(F.count("*").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("started", "run_id")) - 1
    stale = c("started") < F.expr("timestamp_ntz '2001-07-01' - interval 60 seconds")
    return p.withColumn("place", place).join(before, "day").select("run_id", stale.alias("stale"), (c("earlier") + c("place")).alias("ahead"))


@query("tx28_snapshot_diff", "WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(lang) ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0) SELECT b.doc_id, CASE WHEN n.h IS NULL THEN 'gone' WHEN n.h = b.h THEN 'same' ELSE 'replaced' END AS state FROM b LEFT JOIN n USING (doc_id)")
def tx28(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    now = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(c("doc_id") % 4 == 0, F.sha2("lang", 256)).otherwise(c("h")).alias("now"))
    state = F.when(c("now").isNull(), "gone").when(c("now") == c("h"), "same").otherwise("replaced")
    return docs.where("doc_id % 3 <> 0").join(now, "doc_id", "left").select("doc_id", state.alias("state"))


@query("tx29_number_tokens", "SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', ''))))::VARCHAR AS tokens FROM documents WHERE regexp_matches(text, '[0-9]')")
def tx29(spark, d):
    docs = table(spark, d, "documents").where(c("text").rlike("[0-9]"))
    return docs.select("doc_id", F.concat(F.lit("["), F.array_join(F.array_sort(X.number_tokens(c("text"))), ", "), F.lit("]")).alias("tokens"))


@query("tx31_score_from_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 11 WHEN 1 THEN (props::JSON->>'k')::INT END::INT AS score FROM events")
def tx31(spark, d):
    raw = F.when(c("event_id") % 3 == 0, F.concat(F.lit("of 10: score "), c("event_id") % 11)).when(c("event_id") % 3 == 1, c("props")).otherwise("none")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(raw, "$.k").try_cast("int"), X.last_number(raw)).alias("score"))


BLOCKED = ("secret", "password")


@query("tx32_blocked_terms", "SELECT doc_id, contains(lower(text), 'secret') OR contains(lower(text), 'password') AS blocked FROM documents")
def tx32(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.exists(F.array(*map(F.lit, BLOCKED)), lambda t: low.contains(t)).alias("blocked"))


@query("tx33_mentioned_symbols", "SELECT p_partkey, list_sort(list(w))::VARCHAR AS found FROM part JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) t ON contains(p_name, w) GROUP BY 1")
def tx33(spark, d):
    """Which of all words of part names each part's name contains."""
    part = table(spark, d, "part")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    hits = companies.contained(part.select("p_partkey", c("p_name").alias("text")), "p_partkey", names).groupBy("p_partkey").agg(F.array_sort(F.collect_list("name")).alias("f"))
    return hits.select("p_partkey", F.concat(F.lit("["), F.array_join("f", ", "), F.lit("]")).alias("found"))


@query("jon16_mention_clusters", "WITH w AS (SELECT DISTINCT lower(n_name) AS w FROM nation UNION SELECT unnest(['and', 'est', 'the', 'und'])), h AS (SELECT source, w, (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) AS n FROM documents, w WHERE contains(lower(text), w)) SELECT source, w, sum(n)::BIGINT AS n FROM h GROUP BY 1, 2 HAVING sum(n) >= 10")
def jon16(spark, d):
    """Sources that mention a name ten times or more; counted by document and summed, so no text is put together."""
    names = table(spark, d, "nation").select(F.lower("n_name").alias("name")).union(spark.createDataFrame([("and",), ("est",), ("the",), ("und",)], "name string"))
    docs = table(spark, d, "documents")
    hits = companies.contained(docs.select("doc_id", F.lower("text").alias("text")), "doc_id", names)
    return hits.join(docs.select("doc_id", "source"), "doc_id").groupBy("source", c("name").alias("w")).agg(F.sum("n").alias("n")).where("n >= 10")
