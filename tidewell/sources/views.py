"""Views of the test tables that stand for market data, ledgers and filings.

Each view comes twice: as a DataFrame and as a named SQL subquery for the oracle.
Rows are aggregated to bars before any ordered window, so a window over one symbol
holds as many rows as there are bars, whatever the number of trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, time, open, high, low, close, volume) per order priority; whole prices as doubles."""
    won = F.round("o_totalprice").cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("time"), won.alias("won"))
    daily = orders.groupBy("symbol", "time").agg(F.sum("won").alias("s"), F.count("*").alias("n"), F.max("won").alias("hi"), F.min("won").alias("lo"))
    order = Window.partitionBy("symbol").orderBy("time")
    mean = lambda frame: F.floor(F.sum("s").over(frame).cast("double") / F.sum("n").over(frame).cast("double")).cast("double")
    priced = daily.withColumn("close", mean(order.rowsBetween(-19, 0)))
    priced = priced.withColumn("open", F.coalesce(mean(order.rowsBetween(-20, -1)), "close"))
    return priced.select(
        "symbol", "time", "open",
        (F.greatest("open", "close") + F.floor(F.abs(F.col("hi") - F.col("close")) / 100.0)).alias("high"),
        (F.least("open", "close") - F.floor(F.abs(F.col("lo") - F.col("open")) / 120.0)).alias("low"),
        "close", (F.col("n") * 1000 + F.col("s") % 997).cast("double").alias("volume"),
    )


CANDLES = """
daily AS (
  SELECT o_orderpriority AS symbol, o_orderdate::DATE AS time, sum(won)::BIGINT AS s, count(*) AS n, max(won) AS hi, min(won) AS lo
  FROM (SELECT *, round(o_totalprice)::BIGINT AS won FROM orders) GROUP BY 1, 2),
priced AS (
  SELECT *, floor(sum(s) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::DOUBLE
      / sum(n) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)::DOUBLE) AS close,
    floor(sum(s) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)::DOUBLE
      / sum(n) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)::DOUBLE) AS open0
  FROM daily),
opened AS (SELECT *, coalesce(open0, close) AS open FROM priced),
candles AS (
  SELECT symbol, time, open, greatest(open, close) + floor(abs(hi - close) / 100.0::DOUBLE) AS high,
    least(open, close) - floor(abs(lo - open) / 120.0::DOUBLE) AS low, close, (n * 1000 + s % 997)::DOUBLE AS volume FROM opened)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values per event type, in whole cents, with the volume of even users as taker buys."""
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("time"), "ts", "event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    key = F.struct("ts", "event_id")
    cents = F.col("cents")
    return e.groupBy("symbol", "time").agg(
        F.min_by(cents, key).cast("double").alias("open"), F.max(cents).cast("double").alias("high"), F.min(cents).cast("double").alias("low"),
        F.max_by(cents, key).cast("double").alias("close"), F.sum(cents).cast("double").alias("volume"),
        F.sum(F.when(F.col("user_id") % 2 == 0, cents).otherwise(0)).cast("double").alias("taker"), F.count("*").alias("n"),
    )


BARS = """
ev AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS time, ts, event_id, user_id, round(value * 100)::BIGINT AS cents FROM events),
bars AS (
  SELECT symbol, time, arg_min(cents, row(ts, event_id))::DOUBLE AS open, max(cents)::DOUBLE AS high, min(cents)::DOUBLE AS low,
    arg_max(cents, row(ts, event_id))::DOUBLE AS close, sum(cents)::DOUBLE AS volume,
    sum(CASE WHEN user_id % 2 = 0 THEN cents ELSE 0 END)::DOUBLE AS taker, count(*) AS n
  FROM ev GROUP BY 1, 2)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills (user, symbol, side, qty, price, day, ref) from line items: returned items are sales."""
    li, o, c, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    return joined.select(
        F.col("c_nationkey").alias("user"), F.col("p_brand").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("price"),
        F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("ref"), F.col("l_linenumber").cast("long").alias("line"),
        "l_partkey", F.round("l_extendedprice").cast("long").alias("gross"),
    )


LEDGER = """
ledger AS (
  SELECT c_nationkey AS user, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
    l_quantity::BIGINT AS qty, round(l_extendedprice / l_quantity)::BIGINT AS price, l_shipdate::DATE AS day,
    l_orderkey AS ref, l_linenumber::BIGINT AS line, l_partkey, round(l_extendedprice)::BIGINT AS gross
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net positions (user, symbol, qty, cost, avg_price, last_price) of the ledger's buys less sales, where positive."""
    fills = ledger(spark, sf_dir)
    buy = F.col("side") == "BUY"
    key = F.struct("day", "ref", "line", "l_partkey")
    summed = fills.groupBy("user", "symbol").agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(-F.col("qty"))).alias("qty"), F.sum(F.when(buy, F.col("qty"))).alias("bought"),
        F.sum(F.when(buy, F.col("qty") * F.col("price"))).alias("spent"), F.max_by("price", key).alias("last_price"),
    )
    return summed.where("qty > 0").select("user", "symbol", "qty", F.round(F.col("spent") / F.col("bought"), 2).alias("avg_price"), F.col("last_price").cast("double").alias("last_price"))


HOLDINGS = LEDGER + """,
holdings AS (
  SELECT user, symbol, sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END)::BIGINT AS qty,
    round(sum(CASE WHEN side = 'BUY' THEN qty * price END)::DOUBLE / sum(CASE WHEN side = 'BUY' THEN qty END)::DOUBLE, 2) AS avg_price,
    arg_max(price, row(day, ref, line, l_partkey))::DOUBLE AS last_price
  FROM ledger GROUP BY 1, 2 HAVING sum(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) > 0)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked claims (run_id, idx, status, route, latency_ms, s, c) from line items."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "contradicted").when(F.col("l_returnflag") == "A", "supported").otherwise("no_evidence")
    route = F.when(F.col("l_discount") < 0.03, "low").when(F.col("l_discount") > 0.07, "high").otherwise("judge")
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("idx"), F.col("l_partkey").alias("part"), status.alias("status"), route.alias("route"),
        (F.col("l_quantity") * 10).cast("long").alias("latency_ms"), (F.col("l_discount") * 10).alias("s"), (F.col("l_tax") * 10).alias("c"),
    )


CLAIMS = """
claims AS (
  SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS idx, l_partkey AS part,
    CASE l_returnflag WHEN 'R' THEN 'contradicted' WHEN 'A' THEN 'supported' ELSE 'no_evidence' END AS status,
    CASE WHEN l_discount < 0.03::DOUBLE THEN 'low' WHEN l_discount > 0.07::DOUBLE THEN 'high' ELSE 'judge' END AS route,
    (l_quantity * 10)::BIGINT AS latency_ms, l_discount * 10 AS s, l_tax * 10 AS c FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (run_id, user, status, started) from orders."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "partial").otherwise("running")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user"), status.alias("status"), F.col("o_orderdate").alias("started"), F.round("o_totalprice").cast("long").alias("tokens"))


RUNS = """
runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS user, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'partial' ELSE 'running' END AS status,
    o_orderdate AS started, round(o_totalprice)::BIGINT AS tokens FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly facts (company, year, quarter, amount) of ordered amounts by the customer's nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy(F.col("c_nationkey").alias("company"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum(F.round("o_totalprice").cast("long")).alias("amount"), F.count("*").alias("n"))


FACTS = """
facts AS (
  SELECT c_nationkey AS company, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, sum(round(o_totalprice)::BIGINT)::BIGINT AS amount, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply edges (src, dst, weight) from supplier nations to customer nations, of all pairs that trade."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return joined.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("weight"))


EDGES = """
edges AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores (id, y, p, cluster, day): the quality label and a score from the document's text statistics."""
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = (F.length("text") * 7 % 101).cast("double") / 101 + F.col("quality") * (F.length("text") % 5).cast("double") / 25
    return d.join(la, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), F.least(F.lit(1.0), p).alias("p"), F.col("source").alias("cluster"), (F.col("doc_id") % 28).alias("day"), "lang")


GOLD = """
gold AS (
  SELECT d.doc_id AS id, quality::INT AS y, least(1.0::DOUBLE, (length(text) * 7 % 101)::DOUBLE / 101 + quality * (length(text) % 5)::DOUBLE / 25) AS p,
    source AS cluster, d.doc_id % 28 AS day, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
