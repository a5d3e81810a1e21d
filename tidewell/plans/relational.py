"""JON, AGG, TK, SET: joins, aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions import rolling as R
from tidewell.operators import groups as G
from tidewell.sources.views import BARS, CANDLES, CLAIMS, FACTS, HOLDINGS, LEDGER, RUNS, bars, candles, claims, facts, holdings, ledger, runs, table

from . import oracle as O

c = F.col
KST = "strftime({} + INTERVAL 9 HOUR, '%Y%m%d')"


def kst_day(ts: Column) -> Column:
    """Calendar day in Seoul of a UTC time."""
    return F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyyMMdd")


@query("jon01_claims_runs", f"WITH {CLAIMS}, {RUNS} SELECT c.run_id, c.idx, c.part, c.latency_ms, r.user, c.status FROM claims c JOIN runs r USING (run_id) WHERE started >= TIMESTAMP '1997-01-01' AND started < TIMESTAMP '1998-01-01'")
def jon01(spark, d):
    window = runs(spark, d).where("started >= '1997-01-01' and started < '1998-01-01'")
    return claims(spark, d).join(window.select("run_id", "user"), "run_id").select("run_id", "idx", "part", "latency_ms", "user", "status")


@query("jon02_percentile_of_counts", f"WITH {CLAIMS}, {RUNS}, n AS (SELECT run_id, count(*) AS n FROM claims JOIN runs r USING (run_id) WHERE r.status = 'done' GROUP BY run_id) SELECT quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.95)::DOUBLE AS p95 FROM n")
def jon02(spark, d):
    done = runs(spark, d).where("status = 'done'").select("run_id")
    counted = claims(spark, d).join(done, "run_id").groupBy("run_id").agg(F.count("*").alias("n"))
    return counted.agg(F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"))


TARGETS = "targets AS (SELECT p_brand AS symbol, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS weight FROM part WHERE p_size < 25 AND p_brand <> 'Brand#3' GROUP BY 1)"


def targets(spark, d):
    """Target weights (symbol, weight in percent) from the share of small parts of each brand."""
    n = table(spark, d, "part").where("p_size < 25 and p_brand <> 'Brand#3'").groupBy(c("p_brand").alias("symbol")).agg(F.count("*").alias("n"))
    return n.select("symbol", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2).alias("weight"))


@query("jon03_targets_full_outer", f"WITH {HOLDINGS}, {TARGETS}, mine AS (SELECT symbol, qty FROM holdings WHERE user = 7) SELECT coalesce(t.symbol, m.symbol) AS symbol, coalesce(weight, 0) AS weight, coalesce(qty, 0) AS qty FROM targets t FULL JOIN mine m ON t.symbol = m.symbol")
def jon03(spark, d):
    mine = holdings(spark, d).where(c("user") == 7).select("symbol", "qty")
    return targets(spark, d).join(mine, "symbol", "full_outer").select("symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("qty", F.lit(0)).alias("qty"))


QUOTES = "quotes AS (SELECT p_brand AS symbol, round(avg(p_retailprice), 2) AS price FROM part WHERE p_brand NOT IN ('Brand#5', 'Brand#9') GROUP BY 1)"


def quotes(spark, d):
    return table(spark, d, "part").where(~c("p_brand").isin("Brand#5", "Brand#9")).groupBy(c("p_brand").alias("symbol")).agg(F.round(F.avg("p_retailprice"), 2).alias("price"))


@query("jon04_price_fallback", f"WITH {HOLDINGS}, {QUOTES} SELECT user, symbol, coalesce(price, avg_price) AS price FROM holdings LEFT JOIN quotes USING (symbol)")
def jon04(spark, d):
    return holdings(spark, d).join(quotes(spark, d), "symbol", "left").select("user", "symbol", F.coalesce("price", "avg_price").alias("price"))


@query("jon05_ticker_value", f"WITH {HOLDINGS}, {QUOTES} SELECT user, symbol, round(qty * coalesce(price, avg_price), 2) AS value FROM holdings LEFT JOIN quotes USING (symbol)")
def jon05(spark, d):
    return holdings(spark, d).join(quotes(spark, d), "symbol", "left").select("user", "symbol", F.round(c("qty") * F.coalesce("price", "avg_price"), 2).alias("value"))


@query("jon06_unique_match", "WITH u AS (SELECT p_name, min(p_partkey) AS only_key FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1), n AS (SELECT DISTINCT p_name FROM part) SELECT n.p_name, only_key FROM n LEFT JOIN u USING (p_name)")
def jon06(spark, d):
    parts = table(spark, d, "part")
    return G.unique_match(parts.select("p_name").distinct(), parts.select("p_name", c("p_partkey").alias("only_key")), "p_name", "only_key")


@query("jon07_common_dates", f"WITH {CANDLES}, r AS (SELECT symbol, time, close / {O.lag('close')} - 1 AS ret FROM candles), k AS (SELECT time FROM r WHERE ret IS NOT NULL GROUP BY time HAVING count(*) = (SELECT count(DISTINCT symbol) FROM candles)) SELECT symbol, time, round(ret, 6) AS ret FROM r JOIN k USING (time)")
def jon07(spark, d):
    r = candles(spark, d).select("symbol", "time", R.pct_change("close").alias("ret")).where("ret is not null")
    n = r.select("symbol").distinct().agg(F.count("*").alias("all"))
    full = r.groupBy("time").agg(F.count("*").alias("k")).join(F.broadcast(n), c("k") == c("all"), "left_semi").select("time")
    return r.join(full, "time", "left_semi").select("symbol", "time", F.round("ret", 6).alias("ret"))


@query("jon08_same_or_gone", "WITH cur AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, CASE WHEN h IS NULL THEN 'gone' ELSE 'same' END AS state FROM documents LEFT JOIN cur ON sha256(text) = h")
def jon08(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return G.presence(docs, docs.where("doc_id % 2 = 0"), "h").select("doc_id", F.when(c("present"), "same").otherwise("gone").alias("state"))


@query("jon09_stale_ids", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') ON c_custkey = o_custkey")
def jon09(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderdate >= '2001-01-01'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("jon11_period_lookup", f"WITH {FACTS}, m AS (SELECT o_orderkey, o_custkey % 25 AS company, last_day(o_orderdate) AS d FROM orders WHERE month(o_orderdate) % 3 = 0) SELECT o_orderkey, f.amount FROM m LEFT JOIN facts f ON f.company = m.company AND last_day(make_date(year, quarter * 3, 1)) = m.d")
def jon11(spark, d):
    f = facts(spark, d).withColumn("period_end", F.last_day(F.make_date("year", c("quarter") * 3, F.lit(1))))
    m = table(spark, d, "orders").where("month(o_orderdate) % 3 = 0").select("o_orderkey", (c("o_custkey") % 25).cast("int").alias("company"), F.last_day("o_orderdate").alias("period_end"))
    return m.join(f, ["company", "period_end"], "left").select("o_orderkey", "amount")


@query("jon12_nearest_mention", r"""WITH w AS (SELECT doc_id, text, strpos(text, '. ') AS p FROM documents)
SELECT doc_id, CASE WHEN p > 0 AND length(regexp_extract(substr(text, 1, p), '^(?s:(.*))[A-Z]', 1)) + 1 > 0 AND regexp_matches(substr(text, 1, p), '[A-Z]') THEN length(regexp_extract(substr(text, 1, p), '^(?s:(.*))[A-Z]', 1)) + 1 END::INT AS at FROM w""")
def jon12(spark, d):
    """Offset of the last capital before the first sentence's end: an as-of lookup over an array of mentions."""
    docs = table(spark, d, "documents").select("doc_id", F.locate(". ", c("text")).alias("p"), c("text"))
    head = F.expr("substring(text, 1, p)")
    return docs.select("doc_id", F.when((c("p") > 0) & head.rlike("[A-Z]"), F.length(F.regexp_extract(head, r"^((?s:.*))[A-Z]", 1)) + 1).cast("int").alias("at"))


@query("jon13_anchor_asof", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM conversations")
def jon13(spark, d):
    return G.carried(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(c("role") == "user", c("turn")), "anchor").select("conv_id", "turn", "anchor")


@query("jon14_next_bar", f"WITH {BARS}, n AS (SELECT *, lead(time) OVER ({O.W}) AS next, lead(open) OVER ({O.W}) AS entry FROM bars) SELECT symbol, time, entry FROM n WHERE next = time + INTERVAL 1 HOUR")
def jon14(spark, d):
    n = bars(spark, d).withColumns({"next": F.lead("time").over(R.order()), "entry": F.lead("open").over(R.order())})
    return n.where(c("next") == c("time") + F.expr("INTERVAL 1 HOUR")).select("symbol", "time", "entry")


@query("jon17_overlay", f"WITH {CANDLES}, l AS (SELECT symbol, arg_max(close, time) AS close FROM candles GROUP BY 1), a AS (SELECT o_orderpriority AS symbol, count(*) AS n FROM orders WHERE o_orderpriority > '2' GROUP BY 1), b AS (SELECT o_orderpriority AS symbol, round(avg(o_totalprice), 2) AS mean FROM orders WHERE o_orderpriority < '4' GROUP BY 1) SELECT symbol, close, coalesce(n, 0) AS n, mean FROM l LEFT JOIN a USING (symbol) LEFT JOIN b USING (symbol)")
def jon17(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "symbol")
    base = candles(spark, d).groupBy("symbol").agg(F.max_by("close", "time").alias("close"))
    a = o.where("symbol > '2'").groupBy("symbol").agg(F.count("*").alias("n"))
    b = o.where("symbol < '4'").groupBy("symbol").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    return base.join(a, "symbol", "left").join(b, "symbol", "left").select("symbol", "close", F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("jon18_enrich", "SELECT n_nationkey, n_name, r_name, count(s_suppkey) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def jon18(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    live = s.groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(live, "n_nationkey", "left").select("n_nationkey", "n_name", "r_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("agg01_person_credit", "SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS cnt, round(sum(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE round(c_acctbal * 100)::BIGINT END)::DOUBLE / count(*) / 100, 4) AS score FROM customer GROUP BY 1, 2")
def agg01(spark, d):
    """A null counts as 0 in the sum and as a row in the denominator."""
    x = F.when(c("c_custkey") % 9 != 0, F.round(c("c_acctbal") * 100).cast("long"))
    return table(spark, d, "customer").groupBy(c("c_mktsegment").alias("seg"), c("c_nationkey").alias("nation")).agg(F.count("*").alias("cnt"), F.round(G.mean_of_all(x) / 100, 4).alias("score"))


@query("agg02_company_credit", "SELECT p_brand AS brand, count(*) AS cnt, round(sum(CASE WHEN p_size < 40 THEN p_size ELSE 0 END) / count(*), 6) AS grade, round(sum(p_retailprice) / count(*), 2) AS price FROM part GROUP BY 1")
def agg02(spark, d):
    return table(spark, d, "part").groupBy(c("p_brand").alias("brand")).agg(F.count("*").alias("cnt"), F.round(G.mean_of_all(F.when(c("p_size") < 40, c("p_size"))), 6).alias("grade"), F.round(G.mean_of_all(c("p_retailprice")), 2).alias("price"))


@query("agg03_dynamic_group", "WITH g AS (SELECT c_mktsegment, c_nationkey, count(*) AS cnt, avg(c_acctbal) AS score FROM customer WHERE c_nationkey BETWEEN 3 AND 20 GROUP BY 1, 2) SELECT c_mktsegment, sum(cnt)::BIGINT AS cnt, round(avg(score), 4) AS score FROM g GROUP BY 1 ORDER BY cnt DESC, c_mktsegment LIMIT 50")
def agg03(spark, d):
    stats = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("cnt"), F.avg("c_acctbal").alias("score"))
    return G.grouped_report(stats, ["c_mktsegment"], {"c_mktsegment", "c_nationkey"}, c("c_nationkey").between(3, 20), 50)


@query("agg04_counts", f"WITH {CLAIMS} SELECT status, route, count(*) AS n FROM claims GROUP BY 1, 2")
def agg04(spark, d):
    return claims(spark, d).groupBy("status", "route").agg(F.count("*").alias("n"))


@query("agg05_percentiles", f"WITH {CLAIMS} SELECT route, quantile_cont(latency_ms, 0.5)::DOUBLE AS p50, quantile_cont(latency_ms, 0.95)::DOUBLE AS p95, quantile_cont(latency_ms, 0.99)::DOUBLE AS p99 FROM claims GROUP BY 1")
def agg05(spark, d):
    return claims(spark, d).groupBy("route").agg(*[F.percentile("latency_ms", p / 100).alias(f"p{p}") for p in (50, 95, 99)])


@query("agg06_conditional_counts", f"WITH {CLAIMS} SELECT count(*) FILTER (status = 'supported') AS ok, count(*) FILTER (status = 'contradicted' OR route = 'judge') AS hard, count(*) FILTER (latency_ms > 400) AS slow FROM claims")
def agg06(spark, d):
    return claims(spark, d).agg(F.count_if(c("status") == "supported").alias("ok"), F.count_if((c("status") == "contradicted") | (c("route") == "judge")).alias("hard"), F.count_if(c("latency_ms") > 400).alias("slow"))


@query("agg07_daily_sums", f"SELECT {KST.format('ts')} AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY 1 DESC")
def agg07(spark, d):
    return table(spark, d, "events").groupBy(kst_day(c("ts")).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("day"))


@query("agg08_rates_and_alerts", f"WITH {CLAIMS}, a AS (SELECT route, count(*) AS n, count(*) FILTER (status = 'no_evidence') AS bad FROM claims GROUP BY 1) SELECT route, round(coalesce(bad / nullif(n, 0), 0), 6) AS rate, coalesce(bad / nullif(n, 0), 0) > 0.3 AS alert FROM a")
def agg08(spark, d):
    a = claims(spark, d).groupBy("route").agg(F.coalesce(F.try_divide(F.count_if(c("status") == "no_evidence"), F.count("*")), F.lit(0.0)).alias("r"))
    return a.select("route", F.round("r", 6).alias("rate"), (c("r") > 0.3).alias("alert"))


@query("agg09_resample", """WITH b AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS m, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS v FROM events GROUP BY 1, 2),
r AS (SELECT symbol, time_bucket(INTERVAL 2 MINUTE, m, TIMESTAMP '2000-01-01') AS time, arg_min(open, m) AS open, max(high) AS high, min(low) AS low, arg_max(close, m) AS close, sum(v)::BIGINT AS volume, count(*) AS n FROM b GROUP BY 1, 2)
SELECT * EXCLUDE (n) FROM r WHERE n = 2""")
def agg09(spark, d):
    e = table(spark, d, "events")
    key = F.struct("ts", "event_id")
    minutes = e.groupBy(c("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time")).agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("volume"))
    return G.resample(minutes, "2 minutes", 2)


@query("agg10_position_resample", f"WITH {CANDLES}, k AS (SELECT *, (row_number() OVER ({O.W}) - 1) // 5 AS k FROM candles) SELECT symbol, k, min(time) AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM k GROUP BY symbol, k")
def agg10(spark, d):
    k = candles(spark, d).withColumn("k", F.expr("(row_number() over (partition by symbol order by time) - 1) div 5"))
    return k.groupBy("symbol", "k").agg(F.min("time").alias("time"), F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))


RETS = f"rets AS (SELECT symbol, time, close / {O.lag('close')} - 1 AS ret FROM candles)"


def rets(spark, d):
    return candles(spark, d).select("symbol", "time", R.pct_change("close").alias("ret"))


@query("agg11_month_seasonality", f"WITH {CANDLES}, {RETS} SELECT symbol, month(time)::INT AS month, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS std, count(ret) AS n FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2")
def agg11(spark, d):
    return G.seasonality(rets(spark, d), F.month("time"), "month")


@query("agg12_weekday_seasonality", f"WITH {CANDLES}, {RETS} SELECT symbol, (isodow(time) - 1)::INT AS weekday, round(avg(ret), 8) AS mean, round(stddev_samp(ret), 8) AS std, count(ret) AS n FROM rets WHERE ret IS NOT NULL AND isodow(time) <= 5 GROUP BY 1, 2")
def agg12(spark, d):
    return G.seasonality(rets(spark, d).where("weekday(time) < 5"), F.weekday("time"), "weekday")


@query("agg13_year_end_premium", f"WITH {CANDLES}, {RETS} SELECT symbol, round(avg(ret) FILTER (month(time) >= 11) - avg(ret) FILTER (month(time) < 11), 8) AS premium FROM rets GROUP BY 1")
def agg13(spark, d):
    late = F.month("time") >= 11
    return rets(spark, d).groupBy("symbol").agg(F.round(F.avg(F.when(late, c("ret"))) - F.avg(F.when(~late, c("ret"))), 8).alias("premium"))


@query("agg19_sentiment", f"WITH {CLAIMS} SELECT part, round((count(*) FILTER (status = 'supported') - count(*) FILTER (status = 'contradicted')) / nullif(count(*) FILTER (route <> 'judge' OR status <> 'no_evidence'), 0), 6) AS score FROM claims GROUP BY 1")
def agg19(spark, d):
    """Positive less negative over valid rows; null if none is valid."""
    valid = (c("route") != "judge") | (c("status") != "no_evidence")
    return claims(spark, d).groupBy("part").agg(F.round(F.try_divide(F.count_if(c("status") == "supported") - F.count_if(c("status") == "contradicted"), F.count_if(valid)), 6).alias("score"))


@query("agg20_account_snapshot", f"WITH {HOLDINGS}, v AS (SELECT user, sum(qty * last_price) AS value, sum(qty * avg_price) AS spent FROM holdings GROUP BY 1) SELECT user, round(value, 2) AS value, round(1e9 - spent, 2) AS cash, round(value - spent, 2) AS profit, round((value - spent) / nullif(spent, 0) * 100, 4) AS rate FROM v")
def agg20(spark, d):
    v = holdings(spark, d).groupBy("user").agg(F.sum(c("qty") * c("last_price")).alias("value"), F.sum(c("qty") * c("avg_price")).alias("spent"))
    gain = c("value") - c("spent")
    return v.select("user", F.round("value", 2).alias("value"), F.round(1e9 - c("spent"), 2).alias("cash"), F.round(gain, 2).alias("profit"), F.round(F.try_divide(gain, c("spent")) * 100, 4).alias("rate"))


@query("agg21_spread", f"WITH {CANDLES} SELECT time, round(CASE WHEN count(close) >= 2 THEN (max(close) - min(close)) / min(close) END, 6) AS spread FROM candles GROUP BY 1")
def agg21(spark, d):
    return candles(spark, d).groupBy("time").agg(F.round(F.when(F.count("close") >= 2, F.try_divide(F.max("close") - F.min("close"), F.min("close"))), 6).alias("spread"))


@query("agg23_indicator_stats", f"WITH {CANDLES}, s AS (SELECT symbol, time, {O.roll('avg', 'close', 20)} AS x FROM candles), t AS (SELECT * FROM s WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 252) SELECT symbol, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS low, max(x) AS high, arg_max(x, time) AS last FROM t GROUP BY 1")
def agg23(spark, d):
    from tidewell.operators.indicators import last_bar

    t = last_bar(candles(spark, d).withColumn("x", R.sma("close", 20)).where("x is not null"), 252)
    return t.groupBy("symbol").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.max_by("x", "time").alias("last"))


@query("agg24_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("nation", "customer", "orders", "documents")))
def agg24(spark, d):
    each = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("nation", "customer", "orders", "documents")]
    return each[0].union(each[1]).union(each[2]).union(each[3])


@query("agg25_zero_filled", "SELECT r.role, count(text) AS n FROM (VALUES ('user'), ('assistant'), ('system'), ('tool')) r(role) LEFT JOIN conversations c ON c.role = r.role GROUP BY 1")
def agg25(spark, d):
    return G.zero_filled(table(spark, d, "conversations"), "role", ["user", "assistant", "system", "tool"])


@query("agg26_document_list", "SELECT source, lang, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2")
def agg26(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("agg27_latency_without_cold", f"WITH {CLAIMS} SELECT quantile_cont(latency_ms, 0.5)::DOUBLE AS p50, quantile_cont(latency_ms, 0.95)::DOUBLE AS p95, 2 * quantile_cont(latency_ms, 0.95)::DOUBLE AS timeout_ms FROM claims WHERE idx > 1")
def agg27(spark, d):
    p95 = F.percentile("latency_ms", 0.95)
    return claims(spark, d).where("idx > 1").agg(F.percentile("latency_ms", 0.5).alias("p50"), p95.alias("p95"), (2 * p95).alias("timeout_ms"))


@query("agg28_sessions", "WITH g AS (SELECT user_id, ts, event_id, coalesce((ts - lag(ts) OVER w >= INTERVAL 1 HOUR)::INT, 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k")
def agg28(spark, d):
    return G.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", "1 hour")


@query("agg29_trade_metrics", f"WITH {LEDGER}, t AS (SELECT user, day, ref, line, l_partkey, price, ((ref * 37 + line * 11) % 201 - 100) / 1e5 AS r FROM ledger WHERE side = 'SELL'), e AS (SELECT *, product(1 + r) OVER (PARTITION BY user ORDER BY day, ref, line, l_partkey, price) AS eq FROM t), m AS (SELECT *, eq / greatest(1, max(eq) OVER (PARTITION BY user ORDER BY day, ref, line, l_partkey, price)) - 1 AS dd FROM e) SELECT user, count(*) AS n, round(product(1 + r) - 1, 6) AS total, round(min(dd), 6) AS mdd, round(count(*) FILTER (r > 0) / count(*), 6) AS win_rate, round(avg(r), 8) AS mean FROM m GROUP BY 1")
def agg29(spark, d):
    t = ledger(spark, d).where("side = 'SELL'").withColumn("r", ((c("ref") * 37 + c("line") * 11) % 201 - 100) / 1e5)
    return G.trade_metrics(t, "user", ["day", "ref", "line", "l_partkey", "price"], "r")


@query("agg30_distinct", f"WITH {CLAIMS} SELECT count(DISTINCT part) AS parts, count(DISTINCT run_id) AS runs, count(DISTINCT status) AS states FROM claims")
def agg30(spark, d):
    return claims(spark, d).agg(F.count_distinct("part").alias("parts"), F.count_distinct("run_id").alias("runs"), F.count_distinct("status").alias("states"))


@query("tk01_best_rates", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS rate FROM part ORDER BY rate DESC NULLS LAST, p_partkey LIMIT 20")
def tk01(spark, d):
    rate = F.when(c("p_size") % 5 != 0, c("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", rate.alias("rate")).orderBy(F.desc_nulls_last("rate"), "p_partkey").limit(20)


@query("tk02_latest_per_group", "SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def tk02(spark, d):
    """The latest row of each key by aggregation, so a key of many rows is combined before the shuffle."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("tk03_page", "SELECT conv_id, turn, (SELECT count(*) FROM conversations) AS total FROM conversations ORDER BY conv_id, turn LIMIT 20 OFFSET 40")
def tk03(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn").orderBy("conv_id", "turn").offset(40).limit(20).crossJoin(F.broadcast(t.agg(F.count("*").alias("total"))))


@query("tk04_top_users", "SELECT user_id, count(*) AS calls FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def tk04(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "user_id").limit(5)


@query("tk05_name_search", "SELECT p_partkey, p_name FROM part WHERE p_partkey::VARCHAR LIKE '12%' OR p_name LIKE '%ing%' ORDER BY NOT (p_partkey::VARCHAR LIKE '12%'), length(p_name), p_partkey LIMIT 10")
def tk05(spark, d):
    prefix = c("p_partkey").cast("string").startswith("12")
    return table(spark, d, "part").where(prefix | c("p_name").contains("ing")).orderBy(~prefix, F.length("p_name"), "p_partkey").select("p_partkey", "p_name").limit(10)


@query("tk07_representative_fact", f"WITH {FACTS} SELECT company, arg_max(amount, row(n % 2, quarter >= 3, year, quarter)) AS amount FROM facts GROUP BY 1")
def tk07(spark, d):
    return facts(spark, d).groupBy("company").agg(F.max_by("amount", F.struct(c("n") % 2, c("quarter") >= 3, "year", "quarter")).alias("amount"))


@query("tk08_superseded", f"WITH {FACTS} SELECT company, year, quarter, row_number() OVER (PARTITION BY company, year ORDER BY quarter DESC) > 1 AS superseded FROM facts")
def tk08(spark, d):
    newest = F.row_number().over(Window.partitionBy("company", "year").orderBy(F.desc("quarter")))
    return facts(spark, d).select("company", "year", "quarter", (newest > 1).alias("superseded"))


@query("tk09_latest_period", f"WITH {FACTS} SELECT company, max(year * 10 + quarter)::INT AS period FROM facts GROUP BY 1")
def tk09(spark, d):
    best = F.max_by(c("year") * 10 + c("quarter"), F.struct("year", "quarter"))
    return facts(spark, d).groupBy("company").agg(best.alias("period"))


@query("tk10_sector_ranking", f"WITH {CANDLES}, {RETS}, m AS (SELECT symbol, arg_max(ret, time) AS ret FROM rets GROUP BY 1) SELECT symbol, round(ret * 100, 4) AS pct, row_number() OVER (ORDER BY ret DESC, symbol)::INT AS place FROM m")
def tk10(spark, d):
    m = rets(spark, d).groupBy("symbol").agg(F.max_by("ret", "time").alias("ret"))
    return m.select("symbol", F.round(c("ret") * 100, 4).alias("pct"), F.row_number().over(Window.orderBy(F.desc("ret"), "symbol")).alias("place"))


@query("tk11_due_list", "WITH l AS (SELECT user_id, arg_max(row(ts, event_type), row(ts, event_id)) AS x FROM events GROUP BY 1) SELECT user_id, (x[2])::VARCHAR AS decision FROM l WHERE x[1] + INTERVAL 5 DAY <= TIMESTAMP '2024-02-04' AND x[2] <> 'error'")
def tk11(spark, d):
    """Entries whose latest update asks for a review by now, by the decision of that update."""
    latest = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("ts", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return latest.where((c("x.ts") + F.expr("INTERVAL 5 DAYS") <= F.expr("timestamp_ntz '2024-02-04'")) & (c("x.event_type") != "error")).select("user_id", c("x.event_type").alias("decision"))


WORDS = "list_distinct(string_split(p_name, ' '))"


@query("set01_recall", f"SELECT p_partkey, round(len(list_intersect({WORDS}, ['red', 'small', 'ring'])) / len({WORDS}), 6) AS recall FROM part")
def set01(spark, d):
    words = F.array_distinct(F.split("p_name", " "))
    return table(spark, d, "part").select("p_partkey", F.round(F.size(F.array_intersect(words, F.array(*map(F.lit, ("red", "small", "ring"))))) / F.size(words), 6).alias("recall"))


@query("set02_difference", "SELECT DISTINCT p_brand FROM part WHERE p_size < 3 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_retailprice > 1000)")
def set02(spark, d):
    p = table(spark, d, "part")
    return p.where("p_size < 3").select("p_brand").subtract(p.where("p_size = 50 and p_retailprice > 1000").select("p_brand"))


@query("set03_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set03(spark, d):
    return table(spark, d, "customer").select(c("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set04_equal_sets", "WITH a AS (SELECT c_nationkey AS k, list_sort(list(DISTINCT c_mktsegment)) AS s FROM customer GROUP BY 1) SELECT k, s = ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'] AS same FROM a")
def set04(spark, d):
    a = table(spark, d, "customer").groupBy(c("c_nationkey").alias("k")).agg(F.collect_set("c_mktsegment").alias("s"))
    return a.select("k", G.same_set(c("s"), F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))).alias("same"))


@query("set05_concatenation", "SELECT 'c' AS side, c_nationkey::INT AS k FROM customer UNION ALL SELECT 's', s_nationkey::INT FROM supplier")
def set05(spark, d):
    a = table(spark, d, "customer").select(F.lit("c").alias("side"), c("c_nationkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").select(c("s_nationkey").alias("k"), F.lit("s").alias("side")))


@query("set06_subset", f"SELECT p_partkey, list_has_all(['red', 'small', 'ring', 'widget', 'large', 'bolt'], {WORDS}) AS inside FROM part")
def set06(spark, d):
    known = F.array(*map(F.lit, ("red", "small", "ring", "widget", "large", "bolt")))
    return table(spark, d, "part").select("p_partkey", (F.size(F.array_except(F.split("p_name", " "), known)) == 0).alias("inside"))


@query("set07_first_of_equal_sets", "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY list_sort(list_distinct(string_split(p_name, ' ')))")
def set07(spark, d):
    key = F.array_sort(F.array_distinct(F.split("p_name", " ")))
    return table(spark, d, "part").groupBy(key.alias("k")).agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey")


@query("set08_unique_ids", "SELECT p_partkey FROM part")
def set08(spark, d):
    return G.assert_unique(table(spark, d, "part"), "p_partkey").select("p_partkey")
