"""CP and EV: candle patterns, levels, breakouts and the breakout event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators import eventstudy as E
from tidewell.operators import indicators as I
from tidewell.operators import patterns as P
from tidewell.sources.views import bars, candles

from . import oracle as O
from .technical import B, C, GATE, GATE_SQL

c = F.col
ANATOMY = "an AS (SELECT *, greatest(high - low, 1e-9::DOUBLE) AS rng, abs(close - open) AS body, close > open AS bull, close < open AS bear, high - greatest(open, close) AS up_, least(open, close) - low AS dn_ FROM candles), an2 AS (SELECT *, body / rng AS bp FROM an)"
_LAGS = ", ".join(f"lag({x}, {k}) OVER ({O.W}) AS {x}{k}" for x in ("open", "close", "body", "bp", "bull", "bear") for k in (1, 2))
PATTERN_ROWS = f"""{ANATOMY},
pa AS (SELECT *, coalesce({O.roll('avg', 'body', 20)}, body) AS ab, close / {O.lag('close', 5)} - 1 AS t5, row_number() OVER ({O.W}) AS i, count(*) OVER (PARTITION BY symbol) AS n, {_LAGS} FROM an2),
pb AS (SELECT *, coalesce({O.lag('t5')}, 0) > 0.03::DOUBLE AS rising FROM pa)"""
_STAR = "body2 > ab AND body1 < ab * 0.5 AND body > ab"
_FULL = "least(bp, bp1, bp2) > 0.5"
_LOW, _HIGH = "bp <= 0.35::DOUBLE AND dn_ >= 2 * body AND up_ <= body", "bp <= 0.35::DOUBLE AND up_ >= 2 * body AND dn_ <= body"
RULES = {
    "doji": "bp <= 0.1::DOUBLE", "bullish_marubozu": "bp >= 0.9::DOUBLE AND body >= ab AND bull", "bearish_marubozu": "bp >= 0.9::DOUBLE AND body >= ab AND NOT bull",
    "hammer": f"{_LOW} AND NOT rising", "hanging_man": f"{_LOW} AND rising", "inverted_hammer": f"{_HIGH} AND NOT rising", "shooting_star": f"{_HIGH} AND rising",
    "bullish_engulfing": "bull AND bear1 AND close >= open1 AND open <= close1 AND body > body1", "bearish_engulfing": "bear AND bull1 AND open >= close1 AND close <= open1 AND body > body1",
    "morning_star": f"bear2 AND {_STAR} AND bull AND close > (open2 + close2) / 2", "evening_star": f"bull2 AND {_STAR} AND bear AND close < (open2 + close2) / 2",
    "three_white_soldiers": f"bull AND bull1 AND bull2 AND close > close1 AND close1 > close2 AND {_FULL}", "three_black_crows": f"bear AND bear1 AND bear2 AND close < close1 AND close1 < close2 AND {_FULL}",
}


@query("cp00_anatomy", f"{C}, {ANATOMY} SELECT symbol, time, rng AS range, body, round(bp, 6) AS body_pct, up_ AS upper, dn_ AS lower, bull, bear FROM an2")
def cp00(spark, d):
    return P.anatomy(candles(spark, d)).select("symbol", "time", "range", "body", F.round("body_pct", 6).alias("body_pct"), "upper", "lower", "bull", "bear")


def _pattern(id_: str, *names: str):
    sql = " UNION ALL ".join(f"SELECT symbol, time, '{k}' AS pattern FROM pb WHERE n >= 25 AND i > 3 AND {RULES[k]}" for k in names)

    @query(id_, f"{C}, {PATTERN_ROWS} {sql}")
    def run(spark, d):
        return P.candle_patterns(candles(spark, d)).where(c("pattern").isin(*names)).select("symbol", "time", "pattern")


_pattern("cp01_doji", "doji")
_pattern("cp02_marubozu", "bullish_marubozu", "bearish_marubozu")
_pattern("cp03_hammer", "hammer", "hanging_man")
_pattern("cp04_inverted_hammer", "inverted_hammer", "shooting_star")
_pattern("cp05_bullish_engulfing", "bullish_engulfing")
_pattern("cp06_bearish_engulfing", "bearish_engulfing")
_pattern("cp07_morning_star", "morning_star")
_pattern("cp08_evening_star", "evening_star")
_pattern("cp09_three_white_soldiers", "three_white_soldiers")
_pattern("cp10_three_black_crows", "three_black_crows")

RECENT_SQL = " UNION ALL ".join(f"SELECT symbol, time, (n - i)::INT AS bars_ago, '{k}' AS pattern FROM pb WHERE n >= 25 AND i > 3 AND n - i < 5 AND {v}" for k, v in RULES.items())


@query("cp11_recent_patterns", f"{C}, {PATTERN_ROWS} {RECENT_SQL}")
def cp11(spark, d):
    return P.candle_patterns(candles(spark, d), 5).withColumn("bars_ago", c("bars_ago").cast("int"))


FULL_FRAME = f"({O.W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
PIVOTS = f"pv AS (SELECT *, max(high) OVER {FULL_FRAME} AS hi, min(low) OVER {FULL_FRAME} AS lo, count(*) OVER {FULL_FRAME} AS k FROM {{}}), pivots AS (SELECT symbol, time, high AS price, 'high' AS kind FROM pv WHERE k = 11 AND high = hi UNION ALL SELECT symbol, time, low, 'low' FROM pv WHERE k = 11 AND low = lo)"


@query("cp12_pivots", f"{C}, {PIVOTS.format('candles')} SELECT * FROM pivots")
def cp12(spark, d):
    return P.pivots(candles(spark, d))


@query("cp13_level_clusters")
def cp13(spark, d):
    return P.levels(candles(spark, d), most=1_000_000).select("symbol", "price", "touches")


@query("cp14_levels")
def cp14(spark, d):
    return P.levels(candles(spark, d))


BREAK_ROWS = f"""br0 AS (SELECT *, {O.roll('avg', 'close', 20)} AS a, {O.roll('avg', 'close', 60)} AS b FROM candles),
br1 AS (SELECT *, a > b AND {O.lag('a')} <= {O.lag('b')} AS up, a < b AND {O.lag('a')} >= {O.lag('b')} AS dn FROM br0),
{O.bollinger('br1', 'br2')},
br3 AS (SELECT *, max(close) OVER {O.frame(20, 1)} AS hi20, min(close) OVER {O.frame(20, 1)} AS lo20, max(close) OVER {O.frame(251)} AS hi252, min(close) OVER {O.frame(251)} AS lo252,
  volume / greatest(avg(volume) OVER {O.frame(19)}, 1e-9::DOUBLE) >= 1.5 AS loud, row_number() OVER ({O.W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM br2),
br4 AS (SELECT *, i - max(CASE WHEN up THEN i END) OVER {O.frame(4)} AS up_ago, i - max(CASE WHEN dn THEN i END) OVER {O.frame(4)} AS dn_ago FROM br3),
lastb AS (SELECT * FROM br4 WHERE n >= 65 AND i = n)"""


def _break(id_: str, *rows: tuple[str, str, int, str, str]):
    sql = " UNION ALL ".join(f"SELECT symbol, '{key}' AS key, {way} AS direction, {sure} AS confirmed, ({ago})::INT AS bars_ago FROM lastb WHERE {test}" for key, test, way, sure, ago in rows)

    @query(id_, f"{C}, {BREAK_ROWS} {sql}")
    def run(spark, d):
        return P.breakouts(candles(spark, d)).where(c("key").isin(*[r[0] for r in rows]))


_EVENTS = {
    "cp15_breakout_20": (("breakout_20d", "close > hi20", 1, "loud", "0"), ("breakdown_20d", "close < lo20", -1, "loud", "0")),
    "cp17_year_extremes": (("high_52w", "close >= hi252", 1, "true", "0"), ("low_52w", "close <= lo252", -1, "true", "0")),
    "cp18_mean_cross": (("golden_cross", "up_ago IS NOT NULL", 1, "true", "up_ago"), ("dead_cross", "dn_ago IS NOT NULL", -1, "true", "dn_ago")),
    "cp19_band_break": (("bb_upper_break", "close > bb_upper", -1, "false", "0"), ("bb_lower_break", "close < bb_lower", 1, "false", "0")),
}
for _id, _rows in _EVENTS.items():
    _break(_id, *_rows)


@query("cp16_level_breaks")
def cp16(spark, d):
    df = candles(spark, d)
    return P.level_breaks(df, P.levels(df))


@query("cp20_pattern_score")
def cp20(spark, d):
    return P.pattern_score(candles(spark, d))


N, FEE, SLIP = 12, 0.0004, 2.0
SIGNALS = f"""{O.atr('bars', 'ea', 14, 'atr14')},
sg0 AS (SELECT *, row_number() OVER ({O.W}) - 1 AS bar, {O.prior('max', 'high', N)} AS channel FROM ea),
sg1 AS (SELECT *, coalesce(close > channel, false) AS above FROM sg0),
sg AS (SELECT * FROM sg1 QUALIFY above AND NOT coalesce({O.lag('above')}, false))"""


def _hourly(spark, d):
    return I.atr(bars(spark, d), 14, "atr14")


@query("ev01_fresh_breakouts", f"{B}, {SIGNALS} SELECT symbol, time, bar::INT AS bar, channel FROM sg")
def ev01(spark, d):
    return E.signals(_hourly(spark, d), N).select("symbol", "time", "bar", "channel")


@query("ev02_signal_gaps", f"{B}, {SIGNALS} SELECT symbol, time, least(240, coalesce(bar - {O.lag('bar')}, 240))::INT AS gap FROM sg")
def ev02(spark, d):
    return E.signals(_hourly(spark, d), N).select("symbol", "time", "gap")


EXITS = f"""{SIGNALS},
hit AS (SELECT s.symbol, s.bar, min(p.bar) AS xb FROM sg s JOIN sg0 p ON p.symbol = s.symbol AND p.bar > s.bar AND p.bar <= s.bar + 24 AND (p.close <= s.close - 2.0::DOUBLE * s.atr14 OR p.close >= s.close + 3.0::DOUBLE * s.atr14) WHERE s.atr14 IS NOT NULL GROUP BY 1, 2),
nb AS (SELECT symbol, max(bar) AS top FROM sg0 GROUP BY 1),
ex AS (SELECT s.*, coalesce(xb, least(s.bar + 24, top)) AS exit_bar, CASE WHEN xb IS NOT NULL THEN NULL WHEN s.bar + 24 <= top THEN 'time' ELSE 'end' END AS other FROM sg s JOIN nb USING (symbol) LEFT JOIN hit h ON h.symbol = s.symbol AND h.bar = s.bar WHERE s.atr14 IS NOT NULL AND s.bar < top),
tr AS (SELECT e.symbol, e.time, e.bar, exit_bar, coalesce(other, CASE WHEN p.close <= e.close - 2.0::DOUBLE * e.atr14 THEN 'stop' ELSE 'take' END) AS reason, p.close / e.close - 1 AS gross,
  p.close * (1 - {SLIP / 1e4}::DOUBLE) / (e.close * (1 + {SLIP / 1e4}::DOUBLE)) * {(1 - FEE) ** 2!r}::DOUBLE - 1 AS net FROM ex e JOIN sg0 p ON p.symbol = e.symbol AND p.bar = e.exit_bar)"""


@query("ev03_exits", f"{B}, {EXITS} SELECT symbol, time, exit_bar, reason FROM tr")
def ev03(spark, d):
    return E.trades(_hourly(spark, d), N, FEE, SLIP, single=False).select("symbol", "time", "exit_bar", "reason")


@query("ev04_net_returns", f"{B}, {EXITS} SELECT symbol, time, round(gross, 8) AS gross, round(net, 8) AS net FROM tr")
def ev04(spark, d):
    return E.trades(_hourly(spark, d), N, FEE, SLIP, single=False).select("symbol", "time", F.round("gross", 8).alias("gross"), F.round("net", 8).alias("net"))


SINGLE = """
nx AS (SELECT symbol, bar, exit_bar, (SELECT min(q.bar) FROM tr q WHERE q.symbol = t.symbol AND q.bar > t.exit_bar) AS nxt FROM tr t),
tk AS (SELECT symbol, min(bar) AS bar FROM tr GROUP BY 1 UNION ALL SELECT n.symbol, n.nxt FROM tk JOIN nx n ON n.symbol = tk.symbol AND n.bar = tk.bar WHERE n.nxt IS NOT NULL),
one AS (SELECT tr.* FROM tr JOIN tk USING (symbol, bar))"""
RB = "WITH RECURSIVE " + B.removeprefix("WITH ")


@query("ev05_one_at_a_time", f"{RB}, {EXITS},{SINGLE} SELECT symbol, bar, exit_bar, reason FROM one")
def ev05(spark, d):
    return E.trades(_hourly(spark, d), N, FEE, SLIP).select("symbol", "bar", "exit_bar", "reason")


FEATURES = tuple(x for x in GATE if x not in ("atr14", "atr_regime", "range_pos_240")) + ("margin", "gap")
EVENTS = f"""{GATE_SQL},
sg0 AS (SELECT *, row_number() OVER ({O.W}) - 1 AS bar, {O.prior('max', 'high', N)} AS channel FROM gate),
sg1 AS (SELECT *, coalesce(close > channel, false) AS above FROM sg0),
sg2 AS (SELECT * FROM sg1 QUALIFY above AND NOT coalesce({O.lag('above')}, false)),
sg AS (SELECT *, least(240, coalesce(bar - {O.lag('bar')}, 240))::INT AS gap, (close - channel) / nullif(atr14, 0) AS margin FROM sg2),
en AS (SELECT s.*, n.open AS entry FROM sg s JOIN sg0 n ON n.symbol = s.symbol AND n.bar = s.bar + 1 AND n.time = s.time + INTERVAL 1 HOUR WHERE {' AND '.join(f's.{x} IS NOT NULL' for x in FEATURES)}),
hit AS (SELECT s.symbol, s.bar, min(p.bar) AS xb FROM en s JOIN sg0 p ON p.symbol = s.symbol AND p.bar > s.bar AND p.bar <= s.bar + 24 AND (p.close <= s.entry - 2.0::DOUBLE * s.atr14 OR p.close >= s.entry + 3.0::DOUBLE * s.atr14) GROUP BY 1, 2),
ex AS (SELECT s.*, coalesce(xb, s.bar + 24) AS exit_bar, xb IS NULL AS timed FROM en s LEFT JOIN hit h ON h.symbol = s.symbol AND h.bar = s.bar),
evt AS (SELECT e.symbol, e.time, e.bar, e.gap, CASE WHEN timed THEN 'time' WHEN x.close <= e.entry - 2.0::DOUBLE * e.atr14 THEN 'stop' ELSE 'take' END AS reason,
  o.open * (1 - {SLIP / 1e4}::DOUBLE) / (e.entry * (1 + {SLIP / 1e4}::DOUBLE)) * {(1 - FEE) ** 2!r}::DOUBLE - 1 AS net, {', '.join(f'e.{x} AS f_{x}' for x in FEATURES)}
  FROM ex e JOIN sg0 x ON x.symbol = e.symbol AND x.bar = e.exit_bar JOIN sg0 o ON o.symbol = e.symbol AND o.bar = e.exit_bar + 1 AND o.time = x.time + INTERVAL 1 HOUR)"""


def _events(spark, d):
    return E.events(I.gate_features(bars(spark, d)), N, FEE, SLIP, FEATURES)


@query("ev06_event_table", f"{B},{EVENTS} SELECT symbol, time, bar, reason, round(net, 8) AS net, (net < 0)::INT AS label FROM evt")
def ev06(spark, d):
    return _events(spark, d).select("symbol", "time", "bar", "reason", F.round("net", 8).alias("net"), "label")


@query("ev07_event_state", f"{B},{EVENTS} SELECT symbol, time, {', '.join(f'round(f_{x}, 3) AS {x}' for x in FEATURES)} FROM evt")
def ev07(spark, d):
    return _events(spark, d).select("symbol", "time", "state.*")


GRID = (8, 12, 24)


@query("ev08_parameter_choice")
def ev08(spark, d):
    """The channel length with the largest compound return among those with enough trades; the smaller one on ties."""
    df = _hourly(spark, d)
    all_ = None
    for n in GRID:
        one = E.rule_stats(E.trades(df, n, FEE, SLIP)).select(F.lit(n).alias("length"), "n", F.round("compound", 8).alias("compound"))
        all_ = one if all_ is None else all_.union(one)
    best = F.max_by(F.struct("length", "n", "compound"), F.struct("compound", -c("length")))
    return all_.where("n >= 30").agg(best.alias("b")).select("b.*")


@query("ev10_gate_decision", f"{B},{EVENTS} SELECT symbol, time, (f_volume_z IS NULL OR f_taker_ratio >= 0.6::DOUBLE) AS blocked FROM evt")
def ev10(spark, d):
    """An entry is blocked where the gate failed or its probability reaches the threshold."""
    p = c("state.taker_ratio")
    rows = I.gate_features(bars(spark, d)).select("symbol", "time", c("taker_ratio").alias("raw"))
    return _events(spark, d).join(rows, ["symbol", "time"]).select("symbol", "time", (p.isNull() | (c("raw") >= 0.6)).alias("blocked"))


@query("ev11_go_rules", f"{RB}, {EXITS},{SINGLE}, s AS (SELECT count(*) AS n, product(1 + net) - 1 AS comp, avg((net > 0)::INT) AS win FROM one) SELECT n >= 100 AS enough, comp > 0 AS gains, win >= 0.4::DOUBLE AS wins, n >= 100 AND comp > 0 AND win >= 0.4::DOUBLE AS go FROM s")
def ev11(spark, d):
    s = E.rule_stats(E.trades(_hourly(spark, d), N, FEE, SLIP))
    rules = {"enough": c("n") >= 100, "gains": c("compound") > 0, "wins": c("win_rate") >= 0.4}
    return s.select(*[v.alias(k) for k, v in rules.items()]).withColumn("go", c("enough") & c("gains") & c("wins"))


@query("agg16_rule_stats", f"{RB}, {EXITS},{SINGLE} SELECT symbol, count(*) AS n, round(product(1 + net) - 1, 6) AS compound, round(avg(net), 8) AS mean, round(avg((net > 0)::INT), 6) AS win_rate, {', '.join(f'''count(*) FILTER (reason = '{r}') AS "{r}"''' for r in ('stop', 'take', 'time', 'end'))} FROM one GROUP BY 1")
def agg16(spark, d):
    s = E.rule_stats(E.trades(_hourly(spark, d), N, FEE, SLIP), "symbol")
    return s.withColumns({"compound": F.round("compound", 6), "mean": F.round("mean", 8), "win_rate": F.round("win_rate", 6)})


@query("agg14_feature_means", f"{C},{O.features('candles', 'f')} SELECT symbol, {', '.join(f'round(avg({x}), 6) AS {x}' for x in I.FEATURES)} FROM f GROUP BY symbol")
def agg14(spark, d):
    return I.features(candles(spark, d)).groupBy("symbol").agg(*[F.round(F.avg(x), 6).alias(x) for x in I.FEATURES])




@query("ev09_seeded_sample", f"{B},{EVENTS} SELECT symbol, bar FROM evt ORDER BY sha256('7:' || symbol || ':' || bar) LIMIT 30")
def ev09(spark, d):
    """A sampling operator: 30 events in the order of a seeded hash, whatever the partitioning."""
    key = F.sha2(F.concat_ws(":", F.lit("7"), "symbol", "bar"), 256)
    return _events(spark, d).select("symbol", "bar").orderBy(key).limit(30)
