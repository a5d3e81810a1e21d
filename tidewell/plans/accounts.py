"""PF, RB, RK, GS: portfolios, rebalancing, limits and goals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions import rolling as R
from tidewell.operators import portfolio as P
from tidewell.sources.views import BARS, CANDLES, HOLDINGS, LEDGER, bars, candles, holdings, ledger, table

from . import oracle as O
from .relational import QUOTES, TARGETS, kst_day, quotes, targets

c = F.col
LKEY = ["day", "ref", "line", "l_partkey", "price"]
LORD = ", ".join(LKEY)


@query("pf01_order_preview", f"WITH {HOLDINGS} SELECT user, symbol, CASE WHEN qty % 2 = 0 THEN qty <= 5000 ELSE avg_price * 10 <= 20000 END AS executable, CASE WHEN qty % 2 = 0 THEN greatest(qty - 5000, 0) ELSE qty + 10 END AS after FROM holdings")
def pf01(spark, d):
    sells = c("qty") % 2 == 0
    return holdings(spark, d).select("user", "symbol", F.when(sells, c("qty") <= 5000).otherwise(c("avg_price") * 10 <= 20_000).alias("executable"), F.when(sells, F.greatest(c("qty") - 5000, F.lit(0))).otherwise(c("qty") + 10).alias("after"))


FILLS = f"""f AS (SELECT *, row_number() OVER (PARTITION BY user, symbol ORDER BY {LORD}) AS rn FROM ledger WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3')),
a AS (SELECT user, symbol, rn, CASE WHEN side = 'BUY' THEN qty ELSE 0 END AS q, CASE WHEN side = 'BUY' THEN price::DOUBLE ELSE 0 END AS v FROM f WHERE rn = 1
  UNION ALL SELECT f.user, f.symbol, f.rn, CASE WHEN side = 'BUY' THEN a.q + f.qty ELSE a.q - least(a.q, f.qty) END,
    CASE WHEN side = 'BUY' THEN (a.q * a.v + f.qty * f.price) / (a.q + f.qty) WHEN a.q > f.qty THEN a.v ELSE 0 END FROM a JOIN f ON f.user = a.user AND f.symbol = a.symbol AND f.rn = a.rn + 1)"""


@query("pf02_average_cost", f"WITH RECURSIVE {LEDGER}, {FILLS.replace(''' WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#3')''', '')} SELECT user, symbol, q AS pos_qty, round(v, 4) AS pos_avg, rn FROM a")
def pf02(spark, d):
    rows = P.apply_fills(ledger(spark, d), ["user", "symbol"], LKEY)
    rn = F.row_number().over(Window.partitionBy("user", "symbol").orderBy(*LKEY))
    return rows.select("user", "symbol", "pos_qty", F.round("pos_avg", 4).alias("pos_avg"), rn.alias("rn"))


@query("pf03_cost_basis")
def pf03(spark, d):
    """Rounded to cents after each fill, in which engines differ at halves: no oracle, but cases by hand in the tests."""
    fills = ledger(spark, d).withColumns({"qty": c("qty").cast("double") / 7, "price": c("price").cast("double")})
    return P.apply_cost_basis(fills, ["user", "symbol"], LKEY).groupBy("user", "symbol").agg(F.max_by(F.struct("pos_qty", "basis"), F.struct(*LKEY)).alias("p")).select("user", "symbol", "p.*")


@query("pf04_valuation", f"WITH {HOLDINGS}, {QUOTES} SELECT user, symbol, round(qty * coalesce(price, avg_price), 2) AS value, round(coalesce((coalesce(price, avg_price) - avg_price) / nullif(avg_price, 0) * 100, 0), 4) AS rate FROM holdings LEFT JOIN quotes USING (symbol)")
def pf04(spark, d):
    v = P.value(holdings(spark, d), quotes(spark, d))
    return v.select("user", "symbol", F.round("value", 2).alias("value"), F.round("rate", 4).alias("rate"))


@query("pf05_alternative_quote", "SELECT p_partkey, round(p_retailprice * (1 + 0.02 * sin(p_size)), 4) AS price, round(p_retailprice * (1 + 0.02 * sin(p_size)) * 10 * 0.1, 4) AS margin FROM part")
def pf05(spark, d):
    """A quote without a feed: a fixed wave around the reference price; a contract of 10 at 10 % margin."""
    price = c("p_retailprice") * (1 + 0.02 * F.sin("p_size"))
    return table(spark, d, "part").select("p_partkey", F.round(price, 4).alias("price"), F.round(price * 10 * 0.1, 4).alias("margin"))


@query("pf06_turnover_ranking", f"WITH {BARS} SELECT symbol, sum(volume) AS turnover FROM bars WHERE time >= (SELECT max(time) FROM bars) - INTERVAL 23 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def pf06(spark, d):
    b = bars(spark, d)
    last = b.agg(F.max("time").alias("t"))
    day = b.join(F.broadcast(last), c("time") >= c("t") - F.expr("INTERVAL 23 HOURS"))
    return day.groupBy("symbol").agg(F.sum("volume").alias("turnover")).orderBy(F.desc("turnover"), "symbol").limit(3)


@query("pf07_cash_guard", f"WITH {LEDGER}, r AS (SELECT user, {LORD}, 200000000 + sum(CASE WHEN side = 'SELL' THEN gross ELSE -gross END) OVER (PARTITION BY user ORDER BY {LORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cash FROM ledger) SELECT user, min(cash)::BIGINT AS least, count(*) FILTER (cash < 0) AS breaches FROM r GROUP BY 1")
def pf07(spark, d):
    flow = F.when(c("side") == "SELL", c("gross")).otherwise(-c("gross"))
    upto = Window.partitionBy("user").orderBy(*LKEY).rowsBetween(Window.unboundedPreceding, 0)
    r = ledger(spark, d).withColumn("cash", 200_000_000 + F.sum(flow).over(upto))
    return r.groupBy("user").agg(F.min("cash").alias("least"), F.count_if(c("cash") < 0).alias("breaches"))


@query("pf08_allocation")
def pf08(spark, d):
    returns = candles(spark, d).select("symbol", "time", R.pct_change("close").alias("ret")).where("ret is not null")
    a = P.allocate(returns)
    return a.select("symbol", *[F.round(x, 6).alias(x) for x in ("weight", "expected", "volatility")])


PROFILES = (("careful", 20.0, 70.0), ("balanced", 50.0, 40.0), ("bold", 80.0, 15.0))


@query("pf09_strategic_mix", "WITH p(k, stocks, bonds) AS (VALUES (0, 20.0::DOUBLE, 70.0::DOUBLE), (1, 50, 40), (2, 80, 15)), h AS (SELECT c_custkey, bonds, stocks + least(10, c_custkey % 25) AS s FROM customer JOIN p ON k = c_custkey % 3), n AS (SELECT c_custkey, round(s / (s + bonds + 5) * 100, 1) AS stock_w, round(bonds / (s + bonds + 5) * 100, 1) AS bond_w FROM h) SELECT c_custkey, stock_w, bond_w, round(100 - stock_w - bond_w, 1) AS cash_w FROM n")
def pf09(spark, d):
    """Weights of each customer by profile, more stocks for longer horizons; cash takes the rounding."""
    mix = F.element_at(F.array(*(F.struct(F.lit(s).alias("stocks"), F.lit(b).alias("bonds")) for _, s, b in PROFILES)), (c("c_custkey") % 3 + 1).cast("int"))
    p = table(spark, d, "customer").select("c_custkey", mix.alias("mix"), (c("c_custkey") % 25).alias("years"))
    s, bonds = c("mix.stocks") + F.least(F.lit(10), c("years")), c("mix.bonds")
    n = p.select("c_custkey", F.round(s / (s + bonds + 5) * 100, 1).alias("stock_w"), F.round(bonds / (s + bonds + 5) * 100, 1).alias("bond_w"))
    return n.withColumn("cash_w", F.round(100 - c("stock_w") - c("bond_w"), 1))


SCORES = "sc AS (SELECT p_brand AS symbol, count(*) AS n, avg(p_size) AS size, CASE WHEN p_brand <> 'Brand#4' THEN avg(p_retailprice) END AS price FROM part GROUP BY 1)"


def _scores(spark, d):
    return table(spark, d, "part").groupBy(c("p_brand").alias("symbol")).agg(F.count("*").alias("n"), F.avg("p_size").alias("size"), F.when(c("symbol") != "Brand#4", F.avg("p_retailprice")).alias("price"))


@query("pf10_rank_normalised", f"WITH {SCORES} SELECT symbol, round((row_number() OVER (ORDER BY n, symbol) - 1) / greatest(1, count(*) OVER () - 1), 6) AS rank FROM sc")
def pf10(spark, d):
    whole = Window.partitionBy(F.lit(1))
    rank = (F.row_number().over(whole.orderBy("n", "symbol")) - 1) / F.greatest(F.lit(1), F.count("*").over(whole) - 1)
    return _scores(spark, d).select("symbol", F.round(rank, 6).alias("rank"))


@query("pf11_composite", f"WITH {SCORES}, m AS (SELECT symbol, size, coalesce(price, (SELECT median(price) FROM sc)) AS price, CASE WHEN price IS NULL THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS pc, n / 200.0::DOUBLE AS szc FROM sc) SELECT symbol, round((size * 0.6::DOUBLE * szc + price * 0.4::DOUBLE * pc) / (0.6::DOUBLE * szc + 0.4::DOUBLE * pc), 4) AS score FROM m")
def pf11(spark, d):
    s = _scores(spark, d).withColumns({"size_confidence": c("n") / 200.0, "price_confidence": F.when(c("price").isNull(), 0.1)})
    return P.composite(s, {"size": 0.6, "price": 0.4}).withColumn("score", F.round("score", 4))


@query("pf12_projection", "SELECT c_custkey, y::INT AS years, r AS rate, round(c_acctbal * pow(1 + r, y), 4) AS value FROM customer, (VALUES (1), (3), (5), (10)) t(y), (VALUES (0.03::DOUBLE), (0.07::DOUBLE)) q(r)")
def pf12(spark, d):
    """Each customer's balance after some years at two rates."""
    years = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("years"))
    years = years.withColumn("rate", F.explode(F.array(F.lit(0.03), F.lit(0.07))))
    return years.select("c_custkey", "years", "rate", F.round(c("c_acctbal") * F.pow(1 + c("rate"), c("years")), 4).alias("value"))


@query("rb01_targets", f"WITH {TARGETS} SELECT symbol, weight FROM targets")
def rb01(spark, d):
    """Targets with duplicates merged; the query fails beyond 0 to 100 or a total above 100."""
    t = targets(spark, d)
    merged = t.unionByName(t.withColumn("weight", F.lit(0.0))).groupBy("symbol").agg(F.round(F.sum("weight"), 2).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    ok = c("weight").between(0, 100) & (c("total") <= 100.5)
    return merged.withColumn("total", total).withColumn("ok", F.when(ok, True).otherwise(F.raise_error(F.lit("targets out of range")).cast("boolean"))).where("ok").select("symbol", "weight")


VALUES = f"{HOLDINGS}, {QUOTES}, {TARGETS}, hv AS (SELECT user, symbol, (qty * last_price)::DOUBLE AS value FROM holdings)"
SNAP = f"""{VALUES}, fu AS (SELECT coalesce(a.user, h.user) AS user, coalesce(a.symbol, h.symbol) AS symbol, coalesce(weight, 0) AS weight, coalesce(value, 0) AS value
  FROM (SELECT user, symbol, weight FROM (SELECT DISTINCT user FROM hv), targets) a FULL JOIN hv h ON h.user = a.user AND h.symbol = a.symbol),
sn AS (SELECT *, sum(value) OVER (PARTITION BY user) AS equity, coalesce(value / nullif(sum(value) OVER (PARTITION BY user), 0) * 100, 0) AS actual FROM fu), snap AS (SELECT *, actual - weight AS drift, max(abs(actual - weight)) OVER (PARTITION BY user) AS max_drift FROM sn)"""


def _snap(spark, d):
    return P.snapshot(targets(spark, d), holdings(spark, d).withColumn("value", c("qty") * c("last_price")))


@query("rb02_drift", f"WITH {SNAP} SELECT user, symbol, round(actual, 6) AS actual, round(drift, 6) AS drift, round(max_drift, 6) AS max_drift FROM snap")
def rb02(spark, d):
    return _snap(spark, d).select("user", "symbol", *[F.round(x, 6).alias(x) for x in ("actual", "drift", "max_drift")])


PROP = "pr0 AS (SELECT s.*, price, equity * weight / 100 - value AS diff FROM snap s JOIN quotes USING (symbol)), pr AS (SELECT *, CASE WHEN diff > 0 THEN floor(abs(diff) / price) ELSE least(floor(abs(diff) / price), floor(value / price)) END::BIGINT AS qty FROM pr0 WHERE abs(diff) >= greatest(price, 50000))"


@query("rb03_proposals", f"WITH {SNAP}, {PROP} SELECT user, symbol, CASE WHEN diff > 0 THEN 'BUY' ELSE 'SELL' END AS side, qty FROM pr WHERE qty > 0")
def rb03(spark, d):
    return P.proposals(_snap(spark, d), quotes(spark, d), 50_000).select("user", "symbol", "side", "qty")


_FUNDED = """o AS (SELECT user, symbol, CASE WHEN diff > 0 THEN 'BUY' ELSE 'SELL' END AS side, qty, price FROM pr WHERE qty > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY side = 'BUY', -qty * price, symbol) AS rn FROM o),
g AS (SELECT user, 0::BIGINT AS rn, NULL::VARCHAR AS symbol, NULL::VARCHAR AS side, 0::BIGINT AS qty, 0::BIGINT AS filled, 100000.0::DOUBLE AS cash FROM (SELECT DISTINCT user FROM w)
  UNION ALL SELECT user, rn, symbol, side, qty, n, CASE WHEN side = 'SELL' THEN cash + qty * price ELSE cash - n * price END FROM (
    SELECT w.*, g.cash, CASE WHEN w.side = 'SELL' THEN w.qty WHEN g.cash > 0 THEN least(w.qty, floor(g.cash / w.price)::BIGINT) ELSE 0 END AS n FROM g JOIN w ON w.user = g.user AND w.rn = g.rn + 1))"""


@query("rb04_funded_orders", f"WITH RECURSIVE {SNAP}, {PROP}, {_FUNDED} SELECT user, symbol, side, qty, filled FROM g WHERE rn > 0")
def rb04(spark, d):
    orders = P.proposals(_snap(spark, d), quotes(spark, d), 50_000).select("user", "symbol", "side", "qty", "price")
    cash = orders.select("user").distinct().withColumn("cash", F.lit(100_000.0))
    return P.fund_buys(orders, cash).select("user", "symbol", "side", "qty", "filled")


@query("rb05_next_period", "SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS m, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE AS q, (date_trunc('year', o_orderdate) + INTERVAL 12 MONTH)::DATE AS y, (o_orderdate + INTERVAL 1 MONTH)::DATE AS clamped FROM orders")
def rb05(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", P.next_period(day, "month").alias("m"), P.next_period(day, "quarter").alias("q"), P.next_period(day, "year").alias("y"), F.add_months(day, 1).alias("clamped"))


@query("rb06_triggers", f"WITH {SNAP}, u AS (SELECT user, any_value(max_drift) AS md FROM snap GROUP BY 1), recent AS (SELECT DISTINCT c_nationkey AS user FROM customer WHERE c_acctbal > 9900) SELECT u.user, CASE WHEN u.user % 4 = 0 THEN 'TIME' WHEN md >= 5 THEN 'DRIFT' END AS trig FROM u ANTI JOIN recent r ON r.user = u.user")
def rb06(spark, d):
    """TIME comes before DRIFT; users with a recent proposal are left alone."""
    u = _snap(spark, d).groupBy("user").agg(F.max("max_drift").alias("md"))
    recent = table(spark, d, "customer").where("c_acctbal > 9900").select(c("c_nationkey").alias("user")).distinct()
    return u.join(recent, "user", "left_anti").select("user", F.when(c("user") % 4 == 0, "TIME").when(c("md") >= 5, "DRIFT").alias("trig"))


@query("rb07_cash_ledger", f"WITH {LEDGER}, f AS (SELECT user, day, sum(CASE WHEN side = 'SELL' THEN gross ELSE -gross END)::BIGINT AS flow FROM ledger GROUP BY 1, 2) SELECT user, day, flow, sum(flow) OVER (PARTITION BY user ORDER BY day)::BIGINT AS balance FROM f")
def rb07(spark, d):
    f = ledger(spark, d).groupBy("user", "day").agg(F.sum(F.when(c("side") == "SELL", c("gross")).otherwise(-c("gross"))).alias("flow"))
    return f.withColumn("balance", F.sum("flow").over(Window.partitionBy("user").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


COOL = """e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
k AS (SELECT user_id, event_type, rn, ts AS last, true AS taken FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.event_type, e.rn, CASE WHEN e.ts - k.last >= INTERVAL 86400 SECOND THEN e.ts ELSE k.last END, e.ts - k.last >= INTERVAL 86400 SECOND FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.rn = k.rn + 1)"""


@query("rk01_cooldown", f"WITH RECURSIVE {COOL} SELECT e.event_id, k.taken FROM k JOIN e USING (user_id, event_type, rn)")
def rk01(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return P.cooled(e, ["user_id", "event_type"], "ts", "event_id", 86_400).select("event_id", "taken")


@query("rk02_daily_orders", "SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def rk02(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", kst_day(c("ts")).alias("day")).agg(F.count("*").alias("n"))


@query("rk03_day_start", "SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS day, arg_min(value, row(ts, event_id)) AS start FROM events GROUP BY 1, 2")
def rk03(spark, d):
    return table(spark, d, "events").groupBy("user_id", kst_day(c("ts")).alias("day")).agg(F.min_by("value", F.struct("ts", "event_id")).alias("start"))


@query("rk04_daily_loss", "WITH e AS (SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d') AS day, arg_min(value, row(ts, event_id)) AS a, arg_max(value, row(ts, event_id)) AS b FROM events GROUP BY 1, 2) SELECT user_id, day, round((b - a) / nullif(a, 0) * 100, 4) AS pct, coalesce((b - a) / nullif(a, 0) * 100 <= -3, false) AS breach FROM e")
def rk04(spark, d):
    key = F.struct("ts", "event_id")
    e = table(spark, d, "events").groupBy("user_id", kst_day(c("ts")).alias("day")).agg(F.min_by("value", key).alias("a"), F.max_by("value", key).alias("b"))
    pct = F.try_divide(c("b") - c("a"), c("a")) * 100
    return e.select("user_id", "day", F.round(pct, 4).alias("pct"), F.coalesce(pct <= -3, F.lit(False)).alias("breach"))


@query("rk05_buy_cap", f"WITH {HOLDINGS}, t AS (SELECT *, sum(qty * last_price) OVER (PARTITION BY user) AS equity FROM holdings) SELECT user, symbol, greatest(least(500, floor((equity * 30.0 / 100 - qty * last_price) / last_price)), 0)::BIGINT AS cap FROM t")
def rk05(spark, d):
    held = c("qty") * c("last_price")
    t = holdings(spark, d).withColumn("equity", F.sum(held).over(Window.partitionBy("user")))
    return t.select("user", "symbol", P.buy_cap(F.lit(500), c("last_price"), held, c("equity"), 30.0).alias("cap"))


@query("rk06_trading_cycle")
def rk06(spark, d):
    """Best-ranked symbols, gated by score, filled from each user's cash, summed up per user."""
    ranked = _scores(spark, d).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), "symbol"))).where("place <= 5 and size >= 20")
    users = table(spark, d, "nation").select(c("n_nationkey").alias("user"))
    orders = users.crossJoin(F.broadcast(ranked.select("symbol"))).join(quotes(spark, d), "symbol").select("user", "symbol", F.lit("BUY").alias("side"), (c("user") + 5).cast("long").alias("qty"), "price")
    filled = P.fund_buys(orders, users.withColumn("cash", F.lit(50_000.0)))
    return filled.groupBy("user").agg(F.sum("filled").alias("bought"), F.round(F.sum(c("filled") * c("price")), 2).alias("spent"))


@query("rk07_virtual_fills", f"WITH {HOLDINGS}, {QUOTES} SELECT user, symbol, least(5000, qty) AS sold, floor(least(100, 20000 / price))::BIGINT AS bought FROM holdings JOIN quotes USING (symbol)")
def rk07(spark, d):
    h = holdings(spark, d).join(quotes(spark, d), "symbol")
    return h.select("user", "symbol", F.least(F.lit(5000), c("qty")).alias("sold"), F.floor(F.least(F.lit(100.0), 20_000 / c("price"))).alias("bought"))


LEVELS = (("stable", 0), ("careful", 12), ("neutral", 18), ("active", 24), ("bold", 30))


@query("gs01_risk_level", "WITH s AS (SELECT user_id, (sum(event_id % 5 + 1) % 35)::BIGINT AS score FROM events GROUP BY 1) SELECT user_id, score, CASE WHEN score >= 30 THEN 'bold' WHEN score >= 24 THEN 'active' WHEN score >= 18 THEN 'neutral' WHEN score >= 12 THEN 'careful' ELSE 'stable' END AS level FROM s")
def gs01(spark, d):
    """Points of the chosen options summed and looked up in a table of levels."""
    s = table(spark, d, "events").groupBy("user_id").agg((F.sum(c("event_id") % 5 + 1) % 35).alias("score"))
    table_ = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(name).alias("name")) for name, low in LEVELS])
    level = F.element_at(F.filter(table_, lambda x: x["low"] <= c("score")), -1)["name"]
    return s.select("user_id", "score", level.alias("level"))


@query("gs02_goal_simulation")
def gs02(spark, d):
    return P.simulate(spark, 2000, 60, 1000.0, 10.0, 0.08, 0.15, 2200.0)


@query("gs02_goal_without_risk", "SELECT round(1000 * pow(1.08::DOUBLE, 5), 4) AS p50, round(1000 * pow(1.08::DOUBLE, 5), 4) AS p95, 1.0::DOUBLE AS chance")
def gs02b(spark, d):
    s = P.simulate(spark, 50, 60, 1000.0, 0.0, 0.08, 0.0, 1400.0)
    return s.select(F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "chance")


@query("pf08_covariance", f"WITH {CANDLES}, r AS (SELECT symbol, time, close / {O.lag('close')} - 1 AS ret FROM candles) SELECT a.symbol AS one, b.symbol AS two, round(covar_samp(a.ret, b.ret), 10) AS cov FROM r a JOIN r b USING (time) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2")
def pf08b(spark, d):
    r = candles(spark, d).select("symbol", "time", R.pct_change("close").alias("ret")).where("ret is not null")
    return P.covariances(r).select(c("symbol").alias("one"), c("other").alias("two"), F.round("cov", 10).alias("cov"))
