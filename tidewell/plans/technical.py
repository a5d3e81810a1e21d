"""TA01-TA26: technical analysis over daily and hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions import rolling as R
from tidewell.operators import indicators as I
from tidewell.sources.views import BARS, CANDLES, bars, candles

from . import oracle as O

C, B = f"WITH {CANDLES}", f"WITH {BARS}"


def out(df, *columns: str, digits: int = 6):
    """symbol, time and the rounded columns."""
    return df.select("symbol", "time", *[F.round(c, digits).alias(c) for c in columns])


def sel(source: str, *columns: str, digits: int = 6) -> str:
    return f"SELECT symbol, time, {', '.join(O.r(c, c, digits) for c in columns)} FROM {source}"


@query("ta01_sma", f"{C} SELECT symbol, time, {O.r(O.roll('avg', 'close', 20), 'sma20')} FROM candles")
def ta01(spark, d):
    return out(candles(spark, d).withColumn("sma20", R.sma("close", 20)), "sma20")


@query("ta02_ema", f"{C},{O.ewm('candles', 'e', 'close', O.span(20), 'ema20')} {sel('e', 'ema20')}")
def ta02(spark, d):
    return out(I.ema(candles(spark, d), {"ema20": 20}), "ema20")


@query("ta03_rsi", f"{C}, {O.rsi('candles', 'x')} {sel('x', 'rsi')}")
def ta03(spark, d):
    return out(I.rsi(candles(spark, d)), "rsi")


@query("ta04_rsi_wilder", f"{C}, {O.rsi_wilder('candles', 'x')} {sel('x', 'rsi')}")
def ta04(spark, d):
    return out(I.rsi_wilder(candles(spark, d)), "rsi")


_SEEDED = f"""{C}, {O.moves('candles', 'm')},
l AS (SELECT symbol, list(time ORDER BY time) AS ts, list({{'g': gain, 'l': loss}} ORDER BY time) AS xs FROM m WHERE gain IS NOT NULL GROUP BY symbol),
seed AS (SELECT symbol, ts[14:] AS ts, list_prepend({{'g': list_sum(list_transform(xs[1:14], lambda v: v.g)) / 14, 'l': list_sum(list_transform(xs[1:14], lambda v: v.l)) / 14}}, xs[15:]) AS xs FROM l WHERE len(xs) >= 14),
f AS (SELECT symbol, unnest(ts) AS time, unnest(list_reduce(list_transform(xs, lambda v: [v]), lambda acc, v: list_append(acc, {{'g': (acc[-1].g * 13 + v[1].g) / 14, 'l': (acc[-1].l * 13 + v[1].l) / 14}}))) AS s FROM seed)
SELECT c.symbol, c.time, round(100 - 100 / (1 + CASE WHEN s.l > 0 THEN s.g / s.l ELSE 100 END), 2) * CASE WHEN s IS NULL THEN NULL ELSE 1 END AS rsi FROM candles c LEFT JOIN f USING (symbol, time)"""


@query("ta05_rsi_seeded", _SEEDED)
def ta05(spark, d):
    return out(I.rsi_seeded(candles(spark, d)), "rsi", digits=2)


@query("ta06_macd", f"{C},{O.macd('candles')} {sel('mc', 'macd', 'macd_signal', 'macd_hist')}")
def ta06(spark, d):
    return out(I.macd(candles(spark, d)), "macd", "macd_signal", "macd_hist")


@query("ta07_bollinger", f"{C}, {O.bollinger('candles', 'b')} {sel('b', 'bb_mid', 'bb_upper', 'bb_lower')}")
def ta07(spark, d):
    return out(I.bollinger(candles(spark, d)), "bb_mid", "bb_upper", "bb_lower")


@query("ta08_bollinger_population", f"{C}, {O.bollinger('candles', 'b', sd='stddev_pop')} {sel('b', 'bb_mid', 'bb_upper', 'bb_lower', digits=2)}")
def ta08(spark, d):
    return out(I.bollinger(candles(spark, d), population=True), "bb_mid", "bb_upper", "bb_lower", digits=2)


@query("ta09_sma_rounded", f"{C} SELECT symbol, time, {', '.join(O.r(O.roll('avg', 'close', n), f'ma{n}', 2) for n in (5, 20, 60))} FROM candles")
def ta09(spark, d):
    return out(candles(spark, d).withColumns({f"ma{n}": R.sma("close", n) for n in (5, 20, 60)}), "ma5", "ma20", "ma60", digits=2)


@query("ta10_atr", f"{C}, {O.atr('candles', 'a')} {sel('a', 'atr')}")
def ta10(spark, d):
    return out(I.atr(candles(spark, d)), "atr")


RET = f"ret AS (SELECT *, coalesce(close / {O.lag('close')} - 1, 0) AS ret FROM candles)"


def returns(df):
    return df.withColumn("ret", F.coalesce(R.pct_change("close"), F.lit(0.0)))


@query("ta11_sharpe", f"{C}, {RET} SELECT symbol, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0), 6) AS sharpe FROM ret GROUP BY symbol")
def ta11(spark, d):
    ratio = F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))
    return returns(candles(spark, d)).groupBy("symbol").agg(F.round(F.coalesce(ratio, F.lit(0.0)), 6).alias("sharpe"))


@query("ta12_max_drawdown", f"{C}, {RET}, eq AS (SELECT *, product(1 + ret) OVER ({O.W}) AS eq FROM ret), dd AS (SELECT symbol, eq / max(eq) OVER ({O.W}) - 1 AS dd FROM eq) SELECT symbol, round(min(dd), 6) AS mdd FROM dd GROUP BY symbol")
def ta12(spark, d):
    equity = returns(candles(spark, d)).withColumn("eq", F.product(1 + F.col("ret")).over(R.so_far()))
    return equity.withColumn("dd", F.col("eq") / F.max("eq").over(R.so_far()) - 1).groupBy("symbol").agg(F.round(F.min("dd"), 6).alias("mdd"))


@query("ta13_volatility", f"{C}, l AS (SELECT symbol, ln(close / {O.lag('close')}) AS r FROM candles WHERE close > 0) SELECT symbol, round(CASE WHEN count(r) >= 2 THEN stddev_samp(r) * sqrt(252) * 100 END, 6) AS volatility FROM l GROUP BY symbol")
def ta13(spark, d):
    logs = candles(spark, d).where("close > 0").withColumn("r", F.ln(F.col("close") / R.shift("close")))
    return logs.groupBy("symbol").agg(F.round(F.when(F.count("r") >= 2, F.stddev_samp("r") * F.sqrt(F.lit(252.0)) * 100), 6).alias("volatility"))


@query("ta14_features", f"{C},{O.features('candles', 'f')} {sel('f', *I.FEATURES)}")
def ta14(spark, d):
    return out(I.features(candles(spark, d)), *I.FEATURES)


@query("ta15_label", f"{C},{O.features('candles', 'f')} SELECT symbol, time, target FROM f")
def ta15(spark, d):
    return I.features(candles(spark, d)).select("symbol", "time", "target")


RESEARCH = ("ma5", "ma20", "ma60", "rsi", "macd", "macd_signal", "bb_mid", "bb_upper", "bb_lower", "volume_ma20")


@query("ta16_research_frame", f"{C}, {O.research('candles', 'x')} {sel('x', *RESEARCH)}")
def ta16(spark, d):
    return out(I.research(candles(spark, d)), *RESEARCH)


QUOTE_SQL = f"""{_SEEDED.rsplit("SELECT c.symbol", 1)[0]}, q AS (
  SELECT c.symbol, c.time, close, CASE WHEN s IS NOT NULL THEN round(100 - 100 / (1 + CASE WHEN s.l > 0 THEN s.g / s.l ELSE 100 END), 2) END AS rsi FROM candles c LEFT JOIN f USING (symbol, time)),
{O.bollinger('q', 'qb', sd='stddev_pop')},
quote AS (SELECT symbol, time, close, rsi, {', '.join(O.r(O.roll('avg', 'close', n), f'ma{n}', 2) for n in (5, 20, 60))}, round(bb_upper, 2) AS bb_upper, round(bb_mid, 2) AS bb_mid, round(bb_lower, 2) AS bb_lower FROM qb)"""


def quote(df):
    """The rounded indicator bundle of a quote page."""
    df = I.bollinger(I.rsi_seeded(df), population=True)
    mas = {f"ma{n}": F.round(R.sma("close", n), 2) for n in (5, 20, 60)}
    return df.withColumns({**mas, **{c: F.round(c, 2) for c in ("rsi", "bb_upper", "bb_mid", "bb_lower")}}).select("symbol", "time", "close", "rsi", "ma5", "ma20", "ma60", "bb_upper", "bb_mid", "bb_lower")


@query("ta17_quote_bundle", f"{QUOTE_SQL} {O.last_bar('quote', 100)}")
def ta17(spark, d):
    return I.last_bar(quote(candles(spark, d)), 100)


GATE = ("ret_1", "ret_5", "ret_15", "ret_60", "atr14", "atr_regime", "volume_z", "taker_ratio", "range_pos_240", "trend_slope")
GATE_SQL = f"""
{O.atr('bars', 'g1', 14, 'atr14')},
{O.atr('g1', 'g2', 240, 'atr240')},{O.ewm('g2', 'g3', 'close', O.span(60), 'ema60')},
gate AS (
  SELECT *, {', '.join(f"(ln(close) - {O.lag('ln(close)', n)}) * 100 AS ret_{n}" for n in (1, 5, 15, 60))}, atr14 / nullif(atr240, 0) AS atr_regime,
    (volume - {O.prior('avg', 'volume', 60)}) / nullif({O.prior('stddev_samp', 'volume', 60)}, 0) AS volume_z, taker / nullif(volume, 0) AS taker_ratio,
    (close - {O.roll('min', 'low', 240)}) / nullif({O.roll('max', 'high', 240)} - {O.roll('min', 'low', 240)}, 0) AS range_pos_240,
    (ema60 - {O.lag('ema60', 15)}) / nullif(atr14, 0) AS trend_slope
  FROM g3)"""


@query("ta18_gate_features", f"{B},{GATE_SQL} {sel('gate', *GATE)}")
def ta18(spark, d):
    return out(I.gate_features(bars(spark, d)), *GATE)


RULE_SQL = """CASE WHEN score >= 3 THEN 1 WHEN score <= -3 THEN -1 ELSE 0 END"""
SCORE_SQL = """(CASE WHEN rsi < 30 THEN 2 WHEN rsi > 70 THEN -2 ELSE 0 END + sign(macd_hist)::INT + CASE WHEN bb_pos < 0.1::DOUBLE THEN 1 WHEN bb_pos > 0.9::DOUBLE THEN -1 ELSE 0 END + sign(ma5_ratio - ma20_ratio)::INT)"""
SIGNAL_SQL = f"{O.features('candles', 'f')}, scored AS (SELECT *, {SCORE_SQL} AS score FROM f), signals AS (SELECT *, {RULE_SQL} AS signal FROM scored)"


@query("ta19_rule_signal", f"{C},{SIGNAL_SQL} SELECT symbol, time, signal FROM signals")
def ta19(spark, d):
    return I.features(candles(spark, d)).select("symbol", "time", I.rule_signal().alias("signal"))


@query("ta20_quote_signal", f"""{QUOTE_SQL}, p AS (SELECT *, {O.lag('ma5')} AS p5, {O.lag('ma20')} AS p20 FROM quote), lb AS ({O.last_bar('p')}),
s AS (SELECT symbol, (CASE WHEN rsi < 30 THEN 2 WHEN rsi > 70 THEN -2 ELSE 0 END
  + CASE WHEN ma5 IS NULL OR ma20 IS NULL OR p5 IS NULL OR p20 IS NULL THEN 0 WHEN ma5 > ma20 AND p5 <= p20 THEN 3 WHEN ma5 < ma20 AND p5 >= p20 THEN -3 WHEN ma5 > ma20 THEN 1 ELSE -1 END
  + CASE WHEN close < bb_lower THEN 1 WHEN close > bb_upper THEN -1 ELSE 0 END)::INT AS score FROM lb)
SELECT symbol, score, CASE WHEN score >= 3 THEN 'strong buy' WHEN score >= 1 THEN 'buy' WHEN score <= -3 THEN 'strong sell' WHEN score <= -1 THEN 'sell' ELSE 'wait' END AS action FROM s""")
def ta20(spark, d):
    c = F.col
    q = I.last_bar(quote(candles(spark, d)).withColumns({"p5": R.shift("ma5"), "p20": R.shift("ma20")}))
    known = c("ma5").isNotNull() & c("ma20").isNotNull() & c("p5").isNotNull() & c("p20").isNotNull()
    cross = F.when(~known, 0).when((c("ma5") > c("ma20")) & (c("p5") <= c("p20")), 3).when((c("ma5") < c("ma20")) & (c("p5") >= c("p20")), -3).when(c("ma5") > c("ma20"), 1).otherwise(-1)
    score = F.when(c("rsi") < 30, 2).when(c("rsi") > 70, -2).otherwise(0) + cross + F.when(c("close") < c("bb_lower"), 1).when(c("close") > c("bb_upper"), -1).otherwise(0)
    return q.select("symbol", score.alias("score")).withColumn("action", action(c("score"), 1, 3))


def action(score, some: float, strong: float):
    return F.when(score >= strong, "strong buy").when(score >= some, "buy").when(score <= -strong, "strong sell").when(score <= -some, "sell").otherwise("wait")


def frame_score(df):
    """Score -6 to 6 of each symbol's last bar, for symbols of 35 bars or more, with its reasons."""
    c = F.col
    df = I.bollinger(I.macd(I.rsi(df))).withColumns({"ma5": R.sma("close", 5), "ma20": R.sma("close", 20), "n": F.count("*").over(Window.partitionBy("symbol"))})
    side = lambda test, w=1: F.when(test, w).otherwise(-w)
    band = F.when(c("close") > c("bb_upper"), -1).when(c("close") < c("bb_lower"), 1).otherwise(0)
    score = F.when(c("rsi") < 30, 2).when(c("rsi") > 70, -2).otherwise(0) + side(c("ma5") > c("ma20")) + side(c("macd") > c("macd_signal")) + band + side(c("close") > c("bb_mid"))
    reasons = F.array_compact(F.array(
        F.when(c("rsi") < 30, "oversold").when(c("rsi") > 70, "overbought").otherwise("neutral"), F.when(c("ma5") > c("ma20"), "means rise").otherwise("means fall"),
        F.when(c("macd") > c("macd_signal"), "momentum up").otherwise("momentum down"), F.when(band == -1, "above band").when(band == 1, "below band"),
        F.when(c("close") > c("bb_mid"), "above mean").otherwise("below mean"),
    ))
    return I.last_bar(df).where("n >= 35").select("symbol", "time", score.cast("int").alias("score"), F.array_join(reasons, ",").alias("reasons"))


def frame_sql(source: str, name: str) -> str:
    return f"""{O.rsi(source, name + 'r')},{O.macd(name + 'r', name + 'm')},
{O.bollinger(name + 'm', name + 'b')},
{name}x AS (SELECT *, {O.roll('avg', 'close', 5)} AS ma5, {O.roll('avg', 'close', 20)} AS ma20, count(*) OVER (PARTITION BY symbol) AS nb FROM {name}b),
{name} AS (SELECT symbol, time, (CASE WHEN rsi < 30 THEN 2 WHEN rsi > 70 THEN -2 ELSE 0 END + CASE WHEN ma5 > ma20 THEN 1 ELSE -1 END + CASE WHEN macd > macd_signal THEN 1 ELSE -1 END
    + CASE WHEN close > bb_upper THEN -1 WHEN close < bb_lower THEN 1 ELSE 0 END + CASE WHEN close > bb_mid THEN 1 ELSE -1 END)::INT AS score,
    concat_ws(',', CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END, CASE WHEN ma5 > ma20 THEN 'means rise' ELSE 'means fall' END,
      CASE WHEN macd > macd_signal THEN 'momentum up' ELSE 'momentum down' END, CASE WHEN close > bb_upper THEN 'above band' WHEN close < bb_lower THEN 'below band' END,
      CASE WHEN close > bb_mid THEN 'above mean' ELSE 'below mean' END) AS reasons
  FROM {name}x WHERE nb >= 35 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1)"""


@query("ta21_frame_score", f"{C}, {frame_sql('candles', 's')} SELECT * FROM s")
def ta21(spark, d):
    return frame_score(candles(spark, d))


def coarser(df, unit: str):
    """Bars rolled up to weeks or months."""
    return df.groupBy("symbol", F.to_date(F.date_trunc(unit, "time")).alias("t")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("t", "time")


def coarser_sql(name: str, unit: str) -> str:
    return f"{name} AS (SELECT symbol, date_trunc('{unit}', time)::DATE AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM candles GROUP BY 1, 2)"


#: Time frames and the weights their scores have.
FRAMES = (("month", 0.2), ("day", 0.5), ("week", 0.3))


@query("ta22_combined_frames", f"""{C}, {coarser_sql('cw', 'week')}, {coarser_sql('cm', 'month')}, {frame_sql('candles', 's1')}, {frame_sql('cw', 's2')}, {frame_sql('cm', 's3')},
a AS (SELECT symbol, score, 0.5::DOUBLE AS w FROM s1 UNION ALL SELECT symbol, score, 0.3::DOUBLE FROM s2 UNION ALL SELECT symbol, score, 0.2::DOUBLE FROM s3),
b AS (SELECT *, sum(score * w) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS raw FROM a),
c AS (SELECT symbol, round(any_value(raw), 6) AS comp, coalesce(sum(CASE WHEN sign(score) = sign(round(raw, 6)) AND round(raw, 6) <> 0 THEN w END), 0) / sum(w) AS agree FROM b GROUP BY symbol)
SELECT symbol, comp AS composite, round(round(100 * (0.5::DOUBLE * agree + 0.5::DOUBLE * least(1, abs(comp) / 4)), 6))::INT AS confidence, round(agree * 100, 2) AS agreement,
  CASE WHEN comp >= 2.5::DOUBLE THEN 'strong buy' WHEN comp >= 1 THEN 'buy' WHEN comp <= -2.5::DOUBLE THEN 'strong sell' WHEN comp <= -1 THEN 'sell' ELSE 'wait' END AS action FROM c""")
def ta22(spark, d):
    daily = candles(spark, d)
    scored = None
    for unit, weight in FRAMES:
        one = frame_score(daily if unit == "day" else coarser(daily, unit)).select("symbol", "score", F.lit(weight).alias("w"))
        scored = one if scored is None else scored.union(one)
    all_ = Window.partitionBy("symbol")
    raw = F.round(F.sum(F.col("score") * F.col("w")).over(all_) / F.sum("w").over(all_), 6)
    agrees = (F.signum("score") == F.signum("comp")) & (F.col("comp") != 0)
    summed = scored.withColumn("comp", raw).groupBy("symbol").agg(F.first("comp").alias("composite"), (F.coalesce(F.sum(F.when(agrees, F.col("w"))), F.lit(0.0)) / F.sum("w")).alias("agree"))
    confidence = 100 * (0.5 * F.col("agree") + 0.5 * F.least(F.lit(1.0), F.abs("composite") / 4))
    return summed.select("symbol", "composite", F.round(F.round(confidence, 6)).cast("int").alias("confidence"), F.round(F.col("agree") * 100, 2).alias("agreement"), action(F.col("composite"), 1, 2.5).alias("action"))


@query("ta23_frames", "SELECT * FROM (VALUES ('month', 0.2::DOUBLE), ('day', 0.5::DOUBLE), ('week', 0.3::DOUBLE)) t(frame, weight)")
def ta23(spark, d):
    return spark.createDataFrame(list(FRAMES), "frame string, weight double")


SCREEN_SQL = f"""{C}, {O.research('candles', 'x')}, y AS (SELECT * FROM x WHERE ma60 IS NOT NULL AND rsi IS NOT NULL),
p AS (SELECT *, {O.lag('ma5')} AS p5, {O.lag('ma20')} AS p20 FROM y), l AS ({O.last_bar('p')}),
v AS (SELECT symbol, m.model, CASE m.model WHEN 'rsi' THEN (30 - rsi) / 10
    WHEN 'ma' THEN CASE WHEN ma5 > ma20 AND p5 <= p20 THEN 2 WHEN ma5 < ma20 AND p5 >= p20 THEN -2 WHEN ma5 > ma20 THEN 1 ELSE -1 END
    WHEN 'bollinger' THEN CASE WHEN close < bb_lower THEN 2 WHEN close > bb_upper THEN -2 ELSE 0 END
    ELSE CASE WHEN ma5 > ma20 THEN 1 ELSE -1 END + CASE WHEN macd > macd_signal THEN 1 ELSE -1 END + CASE WHEN rsi < 45 THEN 1 WHEN rsi > 65 THEN -1 ELSE 0 END END::DOUBLE AS score
  FROM l, (VALUES ('rsi'), ('ma'), ('bollinger'), ('ensemble')) m(model)),
screen AS (SELECT symbol, model, round(score, 2) AS score, CASE WHEN score >= 1 THEN 'BUY' WHEN score <= -1 THEN 'SELL' ELSE 'HOLD' END AS signal, least(95, floor(55 + abs(score) * 13))::INT AS confidence FROM v)"""
MODELS = ("rsi", "ma", "bollinger", "ensemble")


def screen(df):
    """Score, signal and confidence of each symbol's last bar under each screening model."""
    c = F.col
    df = I.research(df).dropna(subset=list(RESEARCH)).withColumns({"p5": R.shift("ma5"), "p20": R.shift("ma20")})
    up, down = c("ma5") > c("ma20"), c("ma5") < c("ma20")
    scores = {
        "rsi": (30 - c("rsi")) / 10,
        "ma": F.when(up & (c("p5") <= c("p20")), 2).when(down & (c("p5") >= c("p20")), -2).when(up, 1).otherwise(-1),
        "bollinger": F.when(c("close") < c("bb_lower"), 2).when(c("close") > c("bb_upper"), -2).otherwise(0),
        "ensemble": F.when(up, 1).otherwise(-1) + F.when(c("macd") > c("macd_signal"), 1).otherwise(-1) + F.when(c("rsi") < 45, 1).when(c("rsi") > 65, -1).otherwise(0),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), s.cast("double").alias("score")) for m, s in scores.items()]))
    df = I.last_bar(df).select("symbol", each.alias("m")).select("symbol", "m.*")
    signal = F.when(c("score") >= 1, "BUY").when(c("score") <= -1, "SELL").otherwise("HOLD")
    return df.select("symbol", "model", F.round("score", 2).alias("score"), signal.alias("signal"), F.least(F.lit(95), F.floor(55 + F.abs("score") * 13)).cast("int").alias("confidence"))


@query("ta24_screen", f"{SCREEN_SQL} SELECT * FROM screen")
def ta24(spark, d):
    return screen(candles(spark, d))


@query("ta25_screen_ranking", f"{SCREEN_SQL} SELECT *, row_number() OVER (ORDER BY confidence DESC, abs(score) DESC, symbol, model)::INT AS place FROM screen WHERE signal <> 'HOLD' AND confidence >= 60")
def ta25(spark, d):
    found = screen(candles(spark, d)).where("signal <> 'HOLD' AND confidence >= 60")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), F.desc(F.abs("score")), "symbol", "model")))


@query("ta26_snapshot", f"""{C}, x AS (SELECT *, close / {O.lag('close', 20)} - 1 AS r20, {O.roll('avg', 'close', 20)} AS ma20, {O.roll('avg', 'close', 60)} AS ma60, min(close) OVER {O.frame(251)} AS lo, max(close) OVER {O.frame(251)} AS hi FROM candles), l AS ({O.last_bar('x')})
SELECT symbol, time, close, round(r20 * 100, 2) AS ret20, round(ma20, 2) AS ma20, round(ma60, 2) AS ma60, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END, 1) AS range_pos,
  CASE WHEN ma60 IS NULL THEN 'too short' WHEN close > ma20 AND ma20 > ma60 THEN 'rising' WHEN close < ma20 AND ma20 < ma60 THEN 'falling' ELSE 'mixed' END AS trend FROM l""")
def ta26(spark, d):
    c = F.col
    df = candles(spark, d).withColumns({"r20": R.pct_change("close", 20), "ma20": R.sma("close", 20), "ma60": R.sma("close", 60), "lo": F.min("close").over(R.last_rows(252)), "hi": F.max("close").over(R.last_rows(252))})
    place = F.when(c("hi") > c("lo"), (c("close") - c("lo")) / (c("hi") - c("lo")) * 100).otherwise(50.0)
    trend = F.when(c("ma60").isNull(), "too short").when((c("close") > c("ma20")) & (c("ma20") > c("ma60")), "rising").when((c("close") < c("ma20")) & (c("ma20") < c("ma60")), "falling").otherwise("mixed")
    return I.last_bar(df).select("symbol", "time", "close", F.round(c("r20") * 100, 2).alias("ret20"), F.round("ma20", 2).alias("ma20"), F.round("ma60", 2).alias("ma60"), F.round(place, 1).alias("range_pos"), trend.alias("trend"))
