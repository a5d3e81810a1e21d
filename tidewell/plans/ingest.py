"""SRC, SNK, CCH, PRJ: scans of text formats, load plans, cleaning and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators import indicators as I
from tidewell.sources import readers as S
from tidewell.sources import sinks as K
from tidewell.sources.views import BARS, CANDLES, bars, candles, table

from . import oracle as O


@query("src01_candle_arrays", f"WITH {CANDLES} SELECT symbol, time, open, close, CASE WHEN month(time) <> 6 THEN volume END AS volume FROM candles WHERE day(time) <> 13")
def src01(spark, d):
    c = candles(spark, d)
    kept = c.withColumns({"close": F.when(F.dayofmonth("time") != 13, F.col("close")), "volume": F.when(F.month("time") != 6, F.col("volume"))})
    names = ("time", "open", "high", "low", "close", "volume")
    arrays = kept.groupBy("symbol", F.year("time").alias("y")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("b"))
    arrays = arrays.select("symbol", *[F.col(f"b.{n}").alias(n) for n in names])
    return S.candle_arrays(arrays).select("symbol", "time", "open", "close", "volume")


def _kline_lines(spark, d):
    b = bars(spark, d).where("symbol = 'click'")
    seconds = F.unix_timestamp(F.col("time").cast("timestamp"))
    stamp = F.when(F.month("time") == 1, seconds * 1000).otherwise(seconds * 1_000_000)
    line = F.concat_ws(",", stamp, *[F.col(c).cast("long") for c in ("open", "high", "low", "close", "volume")], F.lit("0"), F.lit("0"), F.col("n"), F.col("taker").cast("long"), F.lit("0"), F.lit("0"))
    header = spark.createDataFrame([("open_time,open,high,low,close,volume,close_time,q,n,taker,tq,i",)], "line string")
    return b.select(line.alias("line")).union(header)


_KLINE = "SELECT epoch_us(time) AS open_time, open, high, low, close, volume, taker, epoch_us(time) + 60000000 AS t_close FROM bars WHERE symbol = 'click'"


@query("src02_kline_lines", f"WITH {BARS} {_KLINE}")
def src02(spark, d):
    return S.klines(_kline_lines(spark, d))


@query("src03_kline_range", f"WITH {BARS}, k AS ({_KLINE}) SELECT *, 'a' AS file FROM k")
def src03(spark, d):
    one = _kline_lines(spark, d)
    return S.kline_range(one.withColumn("file", F.lit("b")).union(one.withColumn("file", F.lit("a"))))


def _customer_lines(spark, d):
    c = table(spark, d, "customer")
    line = F.concat_ws(",", F.format_string('"%s, ""all"""', "c_mktsegment"), "c_nationkey", F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")), F.when(F.col("c_custkey") % 7 == 0, "3.0").otherwise(F.col("c_custkey").cast("string")))
    return c.select(F.when(F.col("c_custkey") % 13 == 0, F.lit("broken,line")).otherwise(line).alias("line"))


@query("src05_credit_lines", """SELECT c_mktsegment || ', "all"' AS grp, c_nationkey::BIGINT AS nation, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS score, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS cnt FROM customer WHERE c_custkey % 13 <> 0""")
def src05(spark, d):
    wanted = {"grp": ("segment", 9), "nation": ("nation", 9), "score": ("missing", 2), "cnt": ("missing too", 3)}
    rows = S.credit(_customer_lines(spark, d), ["segment", "nation", "a", "b"], wanted)
    return rows.select("grp", S.safe_int(F.col("nation")).alias("nation"), S.safe_float(F.col("score")).alias("score"), S.safe_int(F.col("cnt")).alias("cnt"))


@query("src06_company_credit_lines", "SELECT s_nationkey::BIGINT AS nation, s_acctbal AS grade FROM supplier")
def src06(spark, d):
    s = table(spark, d, "supplier").select(F.concat_ws(",", F.format_string('"%d, Inc"', "s_suppkey"), "s_nationkey", "s_acctbal", "s_name").alias("line"))
    rows = S.credit(s, ["id", "nation", "grade", "name"], {"nation": ("nation", 0), "grade": ("grade", 0)})
    return rows.select(S.safe_int(F.col("nation")).alias("nation"), S.safe_float(F.col("grade")).alias("grade"))


def _product_lines(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat_ws(",", "p_partkey", F.format_string('"%s, new"', "p_name"), "p_retailprice", F.when(F.col("p_size") > 25, "y").otherwise("N"), F.repeat("p_type", 100)).alias("line"))


@query("src07_product_lines", "SELECT p_partkey::VARCHAR AS code, p_name || ', new' AS name, p_retailprice AS rate, substr(repeat(p_type, 100), 1, 500) AS summary FROM part")
def src07(spark, d):
    return S.products(_product_lines(spark, d)).drop("joinable")


@query("src08_fund_lines", "SELECT p_partkey::VARCHAR AS code, p_size > 25 AS joinable, substr(repeat(p_type, 100), 1, 300) AS summary FROM part")
def src08(spark, d):
    return S.products(_product_lines(spark, d), 300).select("code", "joinable", "summary")


@query("src11_parser_of", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'slides' WHEN 2 THEN 'text' END AS parser FROM pages")
def src11(spark, d):
    p = table(spark, d, "pages")
    name = F.concat(F.lit("a.b/x"), "page_id", F.element_at(F.array(*map(F.lit, (".PDF", ".pptx", ".md", ".exe"))), (F.col("page_id") % 4 + 1).cast("int")))
    return p.select("page_id", S.parser_of(name, strict=False).alias("parser"))


def _page_sql(html: str) -> str:
    """The same cuts, tag by tag, and the references that the pages hold."""
    for pattern in (*(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "nav", "footer", "header")), "<!--.*?-->", "<[^>]*>"):
        html = f"regexp_replace({html}, '{pattern}', ' ', 'gis')"
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("amp", "&")):
        html = f"replace({html}, '&{name};', '{mark}')"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


@query("src12_page_text", f"SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, {_page_sql('html')} AS text FROM pages WHERE length({_page_sql('html')}) >= 100")
def src12(spark, d):
    p = table(spark, d, "pages")
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    out = p.select("page_id", title.alias("title"), S.page_text(F.col("html")).alias("text"))
    return out.where(F.length("text") >= 100)


@query("src13_markdown_text", r"WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE NOT regexp_matches(text, '[#`*_\[]')) SELECT * FROM t WHERE length(text) >= 50")
def src13(spark, d):
    c = table(spark, d, "conversations").where(~F.col("text").rlike(r"[#`*_\[]"))
    marked = F.concat(F.lit("# "), F.regexp_replace("text", r"^(\S+)", "**$1**"), F.lit("\n```\ncode\n```"))
    return c.select("conv_id", "turn", S.markdown_text(marked).alias("text")).where(F.length("text") >= 50)


@query("src14_listed_table", "SELECT s_suppkey AS id, lpad(s_suppkey::VARCHAR, 6, '0') || CASE s_nationkey % 2 WHEN 0 THEN '.KS' ELSE '.KQ' END AS symbol FROM supplier WHERE s_nationkey % 3 <> 2")
def src14(spark, d):
    s = table(spark, d, "supplier")
    code = F.when(F.col("s_nationkey") % 3 == 2, "n/a").otherwise(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    market = F.when(F.col("s_nationkey") % 2 == 0, "main").otherwise("growth")
    suffix = F.create_map(F.lit("main"), F.lit(".KS"), F.lit("growth"), F.lit(".KQ"))
    return s.where(code.rlike("^[0-9A-Z]{6}$")).select(F.col("s_suppkey").alias("id"), F.concat(code, F.try_element_at(suffix, market)).alias("symbol"))


@query("src16_json_rows", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def src16(spark, d):
    wrapped = F.concat(F.lit('{"list":['), "props", F.lit("]}"))
    rows = table(spark, d, "events").select("event_id", F.from_json(wrapped, "list array<struct<k:bigint>>").alias("j"))
    return rows.select("event_id", F.explode("j.list").alias("r")).select("event_id", "r.k")


@query("src17_corpus_names", "SELECT doc_id, source AS category, lang FROM documents")
def src17(spark, d):
    name = F.concat(F.lit("/x/corpus_"), "source", F.lit("-"), "lang", F.lit("_2.zip"))
    docs = table(spark, d, "documents").select("doc_id", name.alias("n"))
    return docs.select("doc_id", F.regexp_extract("n", r"corpus_([^-/]*)-([a-z]{2})_", 1).alias("category"), F.regexp_extract("n", r"corpus_([^-/]*)-([a-z]{2})_", 2).alias("lang"))


def _trade_lines(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Entry Long").otherwise("Exit Long")
    return o.select(F.concat_ws(",", F.format_string('"%,d"', "o_orderkey"), kind, F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(((F.col("o_orderkey") * 37 % 201) - 100) / 10, F.lit("%"))).alias("line"))


@query("src18_trade_lines", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS time, round(((o_orderkey * 37 % 201) - 100) / 10 / 100, 6) AS profit FROM orders WHERE o_orderkey % 2 = 1")
def src18(spark, d):
    rows = S.trades(_trade_lines(spark, d), "﻿Trade #,Type,Date,Profit %")
    return rows.select("time", F.round("profit", 6).alias("profit"))


@query("snk02_upsert", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 2 ELSE 1 END::INT AS version, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN -1 ELSE o_totalprice END AS price FROM orders")
def snk02(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("version"), F.col("o_totalprice").alias("price"), "o_orderdate")
    new = old.where("o_orderdate >= '1998-01-01'").withColumns({"version": F.lit(2), "price": F.lit(-1.0)})
    return K.upsert(old.drop("o_orderdate"), new.drop("o_orderdate"), ["o_orderkey"], "version")


def _loads(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.col("lang").alias("meta"), "source")
    old = docs.where("id % 5 <> 0")
    new = docs.where("id % 7 <> 0").withColumn("sha", F.when(F.col("id") % 3 == 0, F.sha2("sha", 256)).otherwise(F.col("sha"))).withColumn("meta", F.when(F.col("id") % 4 == 0, "xx").otherwise(F.col("meta")))
    return old, new


_LOAD = "CASE WHEN doc_id % 5 = 0 THEN 'insert' WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 3 = 0 THEN 'embed' WHEN doc_id % 4 = 0 THEN 'metadata' ELSE 'skip' END"


@query("snk03_load_plan", f"SELECT doc_id AS id, {_LOAD} AS action FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def snk03(spark, d):
    return K.load_plan(*_loads(spark, d))


@query("snk04_scoped_load_plan", f"SELECT doc_id AS id, {_LOAD} AS action FROM documents WHERE source IN ('src1', 'src2') AND NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)")
def snk04(spark, d):
    old, new = _loads(spark, d)
    return K.load_plan(old, new.where("source in ('src1', 'src2')"), "source")


@query("snk07_export", """SELECT conv_id, turn, '{"role":"' || role || '","ai":' || (role = 'assistant')::VARCHAR || ',"n":' || length(text) || '}' AS body FROM conversations""")
def snk07(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.to_json(F.struct("role", (F.col("role") == "assistant").alias("ai"), F.length("text").alias("n"))).alias("body"))


@query("cch01_fresh", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR")
def cch01(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("updated_at"))
    return K.fresh(e, F.expr("timestamp_ntz '2024-01-20 12:00:00'"), "36 HOURS").select("event_id")


_GAPPY = {"open": "day(time) % 7 = 0", "close": "day(time) % 5 = 0", "volume": "day(time) < 3"}


def _fill(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER ({O.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("prj01_clean_bars", f"""WITH {CANDLES}, g AS (SELECT symbol, time, high, low, {', '.join(f'CASE WHEN NOT ({t}) THEN {c} END AS {c}' for c, t in _GAPPY.items())} FROM candles),
f AS (SELECT symbol, time, {', '.join(f'{_fill(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM g),
b AS (SELECT symbol, time, {', '.join(f'first_value({c} IGNORE NULLS) OVER ({O.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM f)
SELECT * FROM b WHERE close > 0""")
def prj01(spark, d):
    c = candles(spark, d)
    gaps = {k: F.when(F.expr(v), F.when(F.dayofmonth("time") == 14, "bad")).otherwise(F.col(k).cast("string")) for k, v in _GAPPY.items()}
    raw = c.withColumns(gaps).withColumn("time", F.unix_date("time") * 86_400)
    return I.clean(raw).withColumn("time", F.to_date("time"))


@query("prj02_safe_float", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_acctbal END AS x FROM customer")
def prj02(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, "abc").when(F.col("c_custkey") % 4 == 1, "2e14").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.safe_float(raw).alias("x"))


@query("prj03_safe_int", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS x FROM customer")
def prj03(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, "3.0").otherwise("x")
    return table(spark, d, "customer").select("c_custkey", S.safe_int(raw).alias("x"))


@query("prj04_predicates", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' AND (p_name ILIKE '%RED%' OR p_type ILIKE '%eco%') AND p_size >= 10 AND p_retailprice <= 1500")
def prj04(spark, d):
    c = F.col
    return table(spark, d, "part").where(c("p_brand").startswith("Brand#1") & (c("p_name").ilike("%RED%") | c("p_type").ilike("%eco%")) & (c("p_size") >= 10) & (c("p_retailprice") <= 1500)).select("p_partkey")


@query("prj05_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label FROM orders")
def prj05(spark, d):
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), "o_orderstatus").alias("label"))


@query("prj06_period_mask", "SELECT event_id FROM events WHERE epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-11')")
def prj06(spark, d):
    """Open at the start, closed at the end of the last day."""
    ts = F.col("ts")
    return table(spark, d, "events").where((ts > F.expr("timestamp_ntz '2024-01-05'")) & (ts <= F.expr("timestamp_ntz '2024-01-10' + interval 1 day"))).select("event_id")


@query("prj07_visibility", "SELECT doc_id FROM documents WHERE source = 'src3' OR source = 'src0'")
def prj07(spark, d):
    docs = table(spark, d, "documents").withColumn("owner", F.when(F.col("source") != "src0", F.col("source")))
    return docs.where(F.col("owner").isNull() | (F.col("owner") == "src3")).select("doc_id")


@query("prj08_two_layouts", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src4')")
def prj08(spark, d):
    docs = table(spark, d, "documents")
    old = F.col("doc_id") % 2 == 0
    rows = docs.select("doc_id", F.struct(F.when(old, F.col("source")).alias("source")).alias("meta"), F.when(~old, F.col("source")).alias("source"))
    return rows.where(F.coalesce("meta.source", "source").isin("src1", "src4")).select("doc_id")


@query("prj09_price_unit", "SELECT c_custkey, CASE WHEN c_acctbal >= 1000 THEN floor(c_acctbal) ELSE round(c_acctbal, 2) END AS price FROM customer")
def prj09(spark, d):
    p = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(p >= 1000, F.floor(p).cast("double")).otherwise(F.round(p, 2)).alias("price"))


@query("prj10_currency", "SELECT o_orderkey, round(o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 1300 WHEN '2-HIGH' THEN 1450 WHEN '5-LOW' THEN 9 ELSE 1 END, 2) AS won FROM orders")
def prj10(spark, d):
    live = spark.createDataFrame([("1-URGENT", 1300.0), ("2-HIGH", 1450.0)], "cur string, rate double")
    spare = F.create_map(F.lit("2-HIGH"), F.lit(1400.0), F.lit("5-LOW"), F.lit(9.0))
    o = table(spark, d, "orders").join(F.broadcast(live), F.col("o_orderpriority") == F.col("cur"), "left")
    return o.select("o_orderkey", F.round(F.col("o_totalprice") * F.coalesce("rate", F.try_element_at(spare, F.col("o_orderpriority")), F.lit(1.0)), 2).alias("won"))


@query("prj11_scaled_labels", "SELECT o_orderkey, round(o_totalprice / 1e5, 1) AS scaled, substr(strftime(o_orderdate, '%Y'), 3, 2) || 'Q' || quarter(o_orderdate) AS label FROM orders")
def prj11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1e5, 1).alias("scaled"), F.concat(F.date_format("o_orderdate", "yy"), F.lit("Q"), F.quarter("o_orderdate")).alias("label"))


@query("prj12_ticker", "SELECT p_partkey, upper('ab' || p_partkey) AS ticker FROM part")
def prj12(spark, d):
    raw = F.concat(F.lit(" nasdaq:ab"), "p_partkey", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", F.upper(F.trim(F.element_at(F.split(raw, ":"), -1))).alias("ticker"))


@query("prj13_alert", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' END AS side, user_id::DOUBLE AS qty FROM events")
def prj13(spark, d):
    """Alerts as JSON whose fields have several names and whose sides several words."""
    k = F.col("event_id") % 3
    side = F.when(k == 0, '{"action":"","side":"Long"').when(k == 1, '{"action":"매도"').otherwise('{"action":"hold"')
    body = F.concat(side, F.when(F.col("event_id") % 2 == 0, ',"contracts":"').otherwise(',"qty":"'), "user_id", F.lit('"}'))
    field = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("b", f"$.{n}"), F.lit("")) for n in names])
    word = F.lower(field("action", "side"))
    out = F.when(word.isin("buy", "long", "매수"), "BUY").when(word.isin("sell", "short", "exit", "매도"), "SELL")
    return table(spark, d, "events").select("event_id", body.alias("b")).select("event_id", out.alias("side"), field("contracts", "qty").try_cast("double").alias("qty"))


@query("prj14_symbol_parts", "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') AS code, CASE s_suppkey % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'growth' ELSE 'foreign' END AS market FROM supplier")
def prj14(spark, d):
    symbol = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.element_at(F.array(F.lit(".KS"), F.lit(".KQ"), F.lit(".N")), (F.col("s_suppkey") % 3 + 1).cast("int")))
    market = F.when(symbol.endswith(".KS"), "main").when(symbol.endswith(".KQ"), "growth").otherwise("foreign")
    return table(spark, d, "supplier").select("s_suppkey", F.regexp_extract(symbol, r"^([0-9A-Z]{6})", 1).alias("code"), market.alias("market"))


@query("prj15_change", f"WITH {CANDLES}, p AS (SELECT *, {O.lag('close')} AS before FROM candles) SELECT symbol, time, coalesce(close - before, 0) AS change, round(coalesce((close - before) / before * 100, 0), 4) AS pct FROM p")
def prj15(spark, d):
    c = candles(spark, d).withColumn("before", F.lag("close").over(I.R.order()))
    move = F.col("close") - F.col("before")
    return c.select("symbol", "time", F.coalesce(move, F.lit(0.0)).alias("change"), F.round(F.coalesce(F.try_divide(move, F.col("before")) * 100, F.lit(0.0)), 4).alias("pct"))
