"""BT01-BT18: positions, stops and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions import rolling as R
from tidewell.operators import backtest as B
from tidewell.operators import indicators as I
from tidewell.sources.views import CANDLES, candles

from . import oracle as O
from .technical import C, SIGNAL_SQL

CROSS_IN = f"(ma5 > ma20 AND {O.lag('ma5')} <= {O.lag('ma20')})"
CROSS_OUT = f"(ma5 < ma20 AND {O.lag('ma5')} >= {O.lag('ma20')})"


def positions_sql(source: str, enter: str, leave: str, name: str = "pos", entry_wins: bool = False) -> str:
    return f"{name}_e AS (SELECT *, coalesce({enter}, false) AS en, coalesce({leave}, false) AS lv FROM {source}), {name} AS (SELECT *, {O.regime('en', 'lv', entry_wins)} AS position FROM {name}_e)"


def equity_sql(source: str, cost_bps: float, name: str = "eqs", shift_first: bool = True) -> str:
    """Subqueries from bars with position (or ret and held) to the equity frame."""
    begin = f"{name}_h AS (SELECT *, coalesce(close / {O.lag('close')} - 1, 0) AS ret, coalesce(({O.lag('position')} = 1)::INT::DOUBLE, 0) AS held FROM {source})," if shift_first else ""
    source = f"{name}_h" if shift_first else source
    return f"""{begin}
{name}_t AS (SELECT *, abs(held - coalesce({O.lag('held')}, 0)) AS turnover, row_number() OVER ({O.W}) = 1 AS first_bar FROM {source}),
{name}_n AS (SELECT *, turnover * {cost_bps / 10_000}::DOUBLE AS cost, ret * held - turnover * {cost_bps / 10_000}::DOUBLE AS net FROM {name}_t),
{name}_p AS (SELECT *, product(1 + net) OVER ({O.W}) AS eq, product(1 + ret * held) OVER ({O.W}) AS gross_eq, product(1 + ret) OVER ({O.W}) AS hold_eq FROM {name}_n),
{name} AS (SELECT *, eq / max(eq) OVER ({O.W}) - 1 AS drawdown FROM {name}_p)"""


def metrics_sql(source: str, count_first: bool = False, keys: str = "symbol", more: str = "") -> str:
    last = lambda c: f"arg_max({c}, time)"
    return f"""SELECT {keys}, round(({last('eq')} - 1) * 100, 4) AS total_return, round(({last('gross_eq')} - 1) * 100, 4) AS gross_return, round(({last('hold_eq')} - 1) * 100, 4) AS hold_return,
  round(sum(cost) * 100, 4) AS cost, round(coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0), 4) AS sharpe, round(min(drawdown) * 100, 4) AS mdd,
  count(*) FILTER (turnover > 0{'' if count_first else ' AND NOT first_bar'}) AS trades,
  round(coalesce(count(*) FILTER (held = 1 AND net > 0) / nullif(count(*) FILTER (held = 1), 0), 0) * 100, 4) AS win_rate{more} FROM {source} GROUP BY {keys}"""


RSI_BARS = f"{O.rsi('candles', 'x')}"
GOLDEN = f"{RSI_BARS}, y AS (SELECT *, {O.roll('avg', 'close', 5)} AS ma5, {O.roll('avg', 'close', 20)} AS ma20 FROM x)"
FLAGSHIP = f"{C}, {GOLDEN}, {positions_sql('y', f'{CROSS_IN} AND rsi < 65', f'{CROSS_OUT} OR rsi > 80')},{equity_sql('pos', 15)} {metrics_sql('eqs')}"


@query("flagship_cross_backtest", FLAGSHIP)
def flagship(spark, d):
    """A moving-mean cross with a strength filter, from bars to metrics after costs."""
    df = I.rsi(candles(spark, d)).withColumns({"ma5": R.sma("close", 5), "ma20": R.sma("close", 20)})
    df = B.staged_regime(df, R.crossover("ma5", "ma20") & (F.col("rsi") < 65), R.crossunder("ma5", "ma20") | (F.col("rsi") > 80))
    return B.metrics(B.equity(B.held(df), 15))


TIE_IN, TIE_OUT = "rsi < 55", "rsi > 45"


@query("bt01_regime_exit_wins", f"{C}, {O.rsi('candles', 'x')}, {positions_sql('x', TIE_IN, TIE_OUT)} SELECT symbol, time, position::INT AS position FROM pos")
def bt01(spark, d):
    return B.staged_regime(I.rsi(candles(spark, d)), F.expr(TIE_IN), F.expr(TIE_OUT)).select("symbol", "time", "position")


@query("bt02_regime_entry_wins", f"{C}, {O.rsi('candles', 'x')}, {positions_sql('x', TIE_IN, TIE_OUT, entry_wins=True)} SELECT symbol, time, position::INT AS position FROM pos")
def bt02(spark, d):
    return B.staged_regime(I.rsi(candles(spark, d)), F.expr(TIE_IN), F.expr(TIE_OUT), entry_wins=True).select("symbol", "time", "position")


STRATEGY_SQL = {
    "rsi": ("rsi < 30", "rsi > 70"),
    "ma": (CROSS_IN, CROSS_OUT),
    "bollinger": ("close < bb_lower", "close > bb_upper"),
    "composite": ("ma5 > ma20 AND rsi > 50 AND macd > macd_signal", "ma5 < ma20 OR rsi > 75"),
}
RES = f"{O.research('candles', 'x0')}, x AS (SELECT * FROM x0 WHERE ma60 IS NOT NULL AND rsi IS NOT NULL)"


@query("bt03_strategy_positions", f"{C}, {RES}, {', '.join(positions_sql('x', *v, name=k) for k, v in STRATEGY_SQL.items())} SELECT symbol, time, {', '.join(f'{k}.position::INT AS {k}' for k in STRATEGY_SQL)} FROM rsi {' '.join(f'JOIN {k} USING (symbol, time)' for k in list(STRATEGY_SQL)[1:])}")
def bt03(spark, d):
    df = I.research(candles(spark, d)).where("ma60 is not null and rsi is not null")
    for name in STRATEGY_SQL:
        df = B.strategy_position(df, name).withColumnRenamed("position", f"p_{name}")
    return df.select("symbol", "time", *[F.col(f"p_{name}").alias(name) for name in STRATEGY_SQL])


CUSTOM_BARS = f"{O.rsi('candles', 'xr')},{O.macd('xr')},\n{O.bollinger('mc', 'xb')}, x AS (SELECT *, {O.roll('avg', 'close', 5)} AS ma5, {O.roll('avg', 'close', 20)} AS ma20, {O.roll('avg', 'close', 40)} AS ma40, {O.roll('avg', 'volume', 20)} AS vma FROM xb)"
MACD_IN, MACD_OUT = (f"(macd {a} macd_signal AND {O.lag('macd')} {b} {O.lag('macd_signal')})" for a, b in (("> ", "<="), ("<", ">=")))
CUSTOM_SQL = {
    "rsi_ma": (f"{CROSS_IN} AND rsi < 45", f"{CROSS_OUT} OR rsi > 55"),
    "macd_bb": (f"{MACD_IN} AND close < bb_mid", f"{MACD_OUT} OR close > bb_upper"),
    "volume_rsi": ("rsi < 45 AND volume > vma", "rsi > 55"),
    "triple_ma": (f"{CROSS_IN} AND ma20 > ma40", f"{CROSS_OUT} OR ma20 < ma40"),
}


def _custom(df, base):
    return B.custom_position(df, base, buy=45.0)


@query("bt04_custom_strategies", f"{C}, {CUSTOM_BARS}, " + ", ".join(f"{positions_sql('x', *v, name=k)},{equity_sql(k, 15, name=k + '_q')}, {k}_r AS ({metrics_sql(k + '_q')})" for k, v in CUSTOM_SQL.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS base, * FROM {k}_r" for k in CUSTOM_SQL))
def bt04(spark, d):
    df = I.bollinger(I.macd(I.rsi(candles(spark, d))))
    all_ = None
    for base in CUSTOM_SQL:
        one = B.metrics(B.equity(B.held(_custom(df, base)), 15)).withColumn("base", F.lit(base))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_


#: 5 % stop and 8 % take as a recursion over bars, for the oracle.
STOPS_SQL = f"""
st_i AS (SELECT *, row_number() OVER ({O.W}) AS rn, coalesce({O.lag('held')}, 0) AS before, {O.lag('close')} AS c0 FROM st_h),
st_r AS (
  SELECT symbol, rn, CASE WHEN held = 1 THEN CASE WHEN close <= coalesce(c0, close) * (1 - 0.05::DOUBLE) OR close >= coalesce(c0, close) * (1 + 0.08::DOUBLE) THEN NULL ELSE coalesce(c0, close) END END AS entry,
    held = 1 AND (close <= coalesce(c0, close) * (1 - 0.05::DOUBLE) OR close >= coalesce(c0, close) * (1 + 0.08::DOUBLE)) AS blocked, held AS o,
    (held = 1 AND close <= coalesce(c0, close) * (1 - 0.05::DOUBLE))::INT AS sh, 0 AS th FROM st_i WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN o = 1 AND sh = 0 AND th = 0 THEN e END, CASE WHEN sh + th > 0 THEN true ELSE b END, o, sh, th
  FROM (
    SELECT *, CASE WHEN o = 1 AND close <= e * (1 - 0.05::DOUBLE) THEN 1 ELSE 0 END AS sh, CASE WHEN o = 1 AND close > e * (1 - 0.05::DOUBLE) AND close >= e * (1 + 0.08::DOUBLE) THEN 1 ELSE 0 END AS th
    FROM (
      SELECT i.symbol, i.rn, i.close, (r.blocked AND NOT (i.held = 1 AND i.before = 0)) AS b, coalesce(r.entry, i.c0) AS e,
        CASE WHEN i.held = 1 AND NOT (r.blocked AND NOT (i.held = 1 AND i.before = 0)) THEN 1.0::DOUBLE ELSE 0 END AS o
      FROM st_r r JOIN st_i i ON i.symbol = r.symbol AND i.rn = r.rn + 1) q) q2),
st AS (SELECT i.* EXCLUDE (held), r.o AS held, r.sh AS stop_hit, r.th AS take_hit FROM st_i i JOIN st_r r USING (symbol, rn))"""
STOPS = f"{GOLDEN}, {positions_sql('y', 'ma5 > ma20', 'ma5 < ma20')}, st_h AS (SELECT *, coalesce(close / {O.lag('close')} - 1, 0) AS ret, coalesce(({O.lag('position')} = 1)::INT::DOUBLE, 0) AS held FROM pos),{STOPS_SQL}"


def _stopped(spark, d):
    df = I.rsi(candles(spark, d)).withColumns({"ma5": R.sma("close", 5), "ma20": R.sma("close", 20)})
    return B.stops(B.held(B.staged_regime(df, F.col("ma5") > F.col("ma20"), F.col("ma5") < F.col("ma20"))), 0.05, 0.08)


@query("bt05_stops", f"WITH RECURSIVE {CANDLES}, {STOPS} SELECT symbol, time, held, stop_hit, take_hit FROM st")
def bt05(spark, d):
    return _stopped(spark, d).select("symbol", "time", "held", "stop_hit", "take_hit")


BASE6 = f"{C}, {GOLDEN}, {positions_sql('y', 'ma5 > ma20', 'ma5 < ma20')},{equity_sql('pos', 15)}"


def _plain(spark, d):
    df = candles(spark, d).withColumns({"ma5": R.sma("close", 5), "ma20": R.sma("close", 20)})
    return B.equity(B.held(B.staged_regime(df, F.col("ma5") > F.col("ma20"), F.col("ma5") < F.col("ma20"))), 15)


CURVE = ("ret", "held", "cost", "net", "eq", "hold_eq")


@query("bt06_vector_backtest", f"{BASE6} SELECT symbol, time, {', '.join(O.r(c, c) for c in CURVE)} FROM eqs")
def bt06(spark, d):
    return _plain(spark, d).select("symbol", "time", *[F.round(c, 6).alias(c) for c in CURVE])


@query("bt07_metrics", f"WITH RECURSIVE {CANDLES}, {STOPS},{equity_sql('st', 15, shift_first=False)} {metrics_sql('eqs', more=', sum(stop_hit)::BIGINT AS stops, sum(take_hit)::BIGINT AS takes')}")
def bt07(spark, d):
    df = B.equity(_stopped(spark, d), 15)
    return B.metrics(df).join(df.groupBy("symbol").agg(F.sum("stop_hit").alias("stops"), F.sum("take_hit").alias("takes")), "symbol")


@query("bt08_research_backtest", f"""{C}, {RES}, {positions_sql('x', *STRATEGY_SQL['composite'])},{equity_sql('pos', 10)}, m AS ({metrics_sql('eqs', count_first=True)}),
l AS (SELECT symbol, position, {O.lag('position')} AS p0, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS k FROM pos)
SELECT m.*, CASE WHEN position = 1 AND p0 = 0 THEN 'BUY' WHEN position = 0 AND p0 = 1 THEN 'SELL' ELSE 'HOLD' END AS latest FROM m JOIN l USING (symbol) WHERE k = 1""")
def bt08(spark, d):
    df = B.strategy_position(I.research(candles(spark, d)).where("ma60 is not null and rsi is not null"), "composite").withColumn("p0", R.shift("position"))
    last = F.max_by(F.struct("position", "p0"), "time").alias("l")
    latest = F.when((F.col("l.position") == 1) & (F.col("l.p0") == 0), "BUY").when((F.col("l.position") == 0) & (F.col("l.p0") == 1), "SELL").otherwise("HOLD")
    return B.metrics(B.equity(B.held(df), 10), count_first=True).join(df.groupBy("symbol").agg(last).select("symbol", latest.alias("latest")), "symbol")


@query("bt09_curve", f"{BASE6} SELECT symbol, time, round(eq * 100 - 100, 2) AS curve, round(hold_eq * 100 - 100, 2) AS hold FROM eqs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 252")
def bt09(spark, d):
    return I.last_bar(_plain(spark, d), 252).select("symbol", "time", F.round(F.col("eq") * 100 - 100, 2).alias("curve"), F.round(F.col("hold_eq") * 100 - 100, 2).alias("hold"))


LEVEL_SQL = f"lv0 AS (SELECT *, coalesce(({O.roll('avg', 'close', 20)} > {O.roll('avg', 'close', 60)})::INT::DOUBLE, 0) AS up FROM candles), lv AS (SELECT *, coalesce({O.lag('up')}, 0) AS held FROM lv0)"


@query("bt10_mean_level_position", f"{C}, {LEVEL_SQL} SELECT symbol, time, held FROM lv")
def bt10(spark, d):
    return B.lagged_level(candles(spark, d)).select("symbol", "time", "held")


MOM_SQL = f"{positions_sql('candles', 'close > ' + O.prior('max', 'close', 20), 'close < ' + O.prior('min', 'close', 20), name='mo')}, mom AS (SELECT *, coalesce({O.lag('position')}, 0)::DOUBLE AS held FROM mo)"


@query("bt11_momentum_position", f"{C}, {MOM_SQL} SELECT symbol, time, held FROM mom")
def bt11(spark, d):
    return B.momentum(candles(spark, d)).select("symbol", "time", "held")


DCA_SQL = f"""dc AS (SELECT *, row_number() OVER ({O.W}) - 1 AS i, 1.0::DOUBLE / ((count(*) OVER (PARTITION BY symbol) - 1) // 21 + 1) AS share FROM candles),
dca AS (SELECT symbol, time, sum(CASE WHEN i % 21 = 0 AND close > 0 THEN share / close ELSE 0 END) OVER ({O.W}) * close + 1 - sum(CASE WHEN i % 21 = 0 AND close > 0 THEN share ELSE 0 END) OVER ({O.W}) AS eq FROM dc)"""


@query("bt12_instalments", f"{C}, {DCA_SQL} SELECT symbol, time, round(eq, 6) AS eq FROM dca")
def bt12(spark, d):
    return B.instalments(candles(spark, d)).select("symbol", "time", F.round("eq", 6).alias("eq"))


CURVE13 = f"{LEVEL_SQL}, lr AS (SELECT *, coalesce(close / {O.lag('close')} - 1, 0) AS ret FROM lv), cv AS (SELECT *, product(1 + ret * held) OVER ({O.W}) AS eq FROM lr)"
SPAN = "time BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"
WINDOW_SQL = f"wd AS (SELECT *, eq / first_value(eq) OVER ({O.W}) AS norm, row_number() OVER ({O.W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM cv WHERE {SPAN})"


def _curve(spark, d):
    df = B.lagged_level(candles(spark, d)).withColumn("ret", F.coalesce(R.pct_change("close"), F.lit(0.0)))
    return df.withColumn("eq", F.product(1 + F.col("ret") * F.col("held")).over(R.so_far()))


@query("bt13_equity_window", f"{C}, {CURVE13}, {WINDOW_SQL} SELECT symbol, time, round(norm, 6) AS eq FROM wd")
def bt13(spark, d):
    return _curve(spark, d).where(SPAN).select("symbol", "time", F.round(F.col("eq") / F.first("eq").over(R.so_far()), 6).alias("eq"))


@query("bt14_annual_metrics", f"""{C}, {CURVE13}, z AS (SELECT *, eq / {O.lag('eq')} - 1 AS r, abs(held - coalesce({O.lag('held')}, 0)) AS dd FROM cv),
g AS (SELECT symbol, (pow(arg_max(eq, time) / arg_min(eq, time), 1 / ((count(*) - 1) / 252.0::DOUBLE)) - 1) * 100 AS growth, coalesce(stddev_pop(r), 0) * sqrt(252) * 100 AS vol, avg(held) * 100 AS invested, count(*) FILTER (dd > 0.001::DOUBLE) AS changes FROM z GROUP BY symbol)
SELECT symbol, round(growth, 4) AS growth, round(vol, 4) AS volatility, round(coalesce((growth / 100 - 0.02::DOUBLE) / nullif(vol / 100, 0), 0), 4) AS sharpe, round(invested, 4) AS invested, changes FROM g""")
def bt14(spark, d):
    return B.annual(_curve(spark, d))


@query("bt15_sampled_curve", f"{C}, {CURVE13}, {WINDOW_SQL} SELECT symbol, time, round(norm * 100 - 100, 4) AS curve FROM wd WHERE (rn - 1) % greatest(1, n // 120) = 0 OR rn = n")
def bt15(spark, d):
    whole = R.Window.partitionBy("symbol")
    df = _curve(spark, d).where(SPAN).withColumns({"norm": F.col("eq") / F.first("eq").over(R.so_far()), "rn": F.row_number().over(R.order()), "n": F.count("*").over(whole)})
    return df.where("(rn - 1) % greatest(1, n div 120) = 0 or rn = n").select("symbol", "time", F.round(F.col("norm") * 100 - 100, 4).alias("curve"))


def warm_up_days(strategy: str, n: int = 60) -> int:
    """Calendar days of bars that a strategy needs before its window: none for holding and instalments."""
    return {"ma_cross": 2 * n + 10, "momentum": 2 * n + 10}.get(strategy, 0)


@query("bt17_metric_comparison", f"""{C}, {CURVE13}, o AS (SELECT symbol, (arg_max(eq, time) - 1) * 100 AS own, min(dd) * 100 AS own_mdd FROM (SELECT *, eq / max(eq) OVER ({O.W}) - 1 AS dd FROM cv) GROUP BY symbol),
e AS (SELECT symbol, (product(1 + ret) - 1) * 100 AS other FROM cv GROUP BY symbol)
SELECT symbol, round(own - other, 4) AS return_diff, round(abs(own_mdd), 4) AS mdd_abs, CASE WHEN abs(own - other) <= 3 THEN 'match' WHEN abs(own - other) <= 10 THEN 'close' ELSE 'different' END AS verdict FROM o JOIN e USING (symbol)""")
def bt17(spark, d):
    df = _curve(spark, d).withColumn("dd", F.col("eq") / F.max("eq").over(R.so_far()) - 1)
    own = df.groupBy("symbol").agg(((F.max_by("eq", "time") - 1) * 100).alias("own"), (F.min("dd") * 100).alias("mdd"), ((F.product(1 + F.col("ret")) - 1) * 100).alias("other"))
    gap = F.col("own") - F.col("other")
    return own.select("symbol", F.round(gap, 4).alias("return_diff"), F.round(F.abs("mdd"), 4).alias("mdd_abs"), F.when(F.abs(gap) <= 3, "match").when(F.abs(gap) <= 10, "close").otherwise("different").alias("verdict"))


@query("bt18_signal_run", f"{C},{SIGNAL_SQL}, sp AS (SELECT *, signal AS position FROM signals),{equity_sql('sp', 15)} {metrics_sql('eqs')}")
def bt18(spark, d):
    df = I.features(candles(spark, d)).withColumn("position", I.rule_signal())
    return B.metrics(B.equity(B.held(df), 15))


@query("agg22_signal_counts", f"{C},{SIGNAL_SQL}, t AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 50) SELECT symbol, count(*) FILTER (signal = 1) AS buys, count(*) FILTER (signal = -1) AS sells, count(*) FILTER (signal = 0) AS waits FROM t GROUP BY symbol")
def agg22(spark, d):
    last = I.last_bar(I.features(candles(spark, d)).withColumn("signal", I.rule_signal()), 50)
    return last.groupBy("symbol").agg(F.count_if(F.col("signal") == 1).alias("buys"), F.count_if(F.col("signal") == -1).alias("sells"), F.count_if(F.col("signal") == 0).alias("waits"))



WARM = {"buy_hold": 0, "ma_cross": 55, "momentum": 35}


@query("bt16_warm_up", f"{C} SELECT symbol, strategy, count(*) FILTER (time::DATE < DATE '1995-06-01') AS before, count(*) FILTER (time::DATE >= DATE '1995-06-01') AS asked FROM candles, (VALUES " + ", ".join(f"('{k}', {n})" for k, n in WARM.items()) + ") w(strategy, days) WHERE time::DATE >= DATE '1995-06-01' - days::INT GROUP BY 1, 2")
def bt16(spark, d):
    """Bars that each strategy reads before the first day asked for, and those asked for."""
    all_ = None
    for name in WARM:
        one = B.warmed(candles(spark, d), name, F.lit("1995-06-01").cast("date"), 20, 10).groupBy("symbol").agg(F.count_if(~F.col("asked")).alias("before"), F.count_if("asked").alias("asked")).withColumn("strategy", F.lit(name))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_
