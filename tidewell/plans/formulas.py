"""FX: the formula functions over bars, and template strategies built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions import rolling as R
from tidewell.operators import backtest as B
from tidewell.operators import formula as X
from tidewell.operators import indicators as I
from tidewell.sources.views import candles

from . import oracle as O
from .backtests import equity_sql, metrics_sql, positions_sql
from .technical import C, out, sel

c = F.col


def _columns(id_: str, sql: dict[str, str], make, digits: int = 6):
    """A query of one or more column functions over daily bars."""
    text = ", ".join(f"round({x}, {digits}) AS {n}" for n, x in sql.items())

    @query(id_, f"{C}, base AS (SELECT *, close - {O.lag('close')} AS d, row_number() OVER ({O.W}) AS bar FROM candles) SELECT symbol, time, {text} FROM base")
    def run(spark, d):
        df = candles(spark, d).withColumns({"d": R.change("close"), "bar": F.row_number().over(R.order())})
        made = make()
        return df.withColumns(made).select("symbol", "time", *[F.round(n, digits).alias(n) for n in made])


_columns("fx10_sma_mean", {"m": O.roll("avg", "close", 10)}, lambda: {"m": R.sma("close", 10)})
_columns("fx16_std", {"s": O.roll("stddev_samp", "close", 10)}, lambda: {"s": R.std("close", 10)})
_columns("fx17_extremes", {"hi": O.roll("max", "high", 10), "lo": O.roll("min", "low", 10), "total_": O.roll("sum", "volume", 10)}, lambda: {"hi": R.highest("high", 10), "lo": R.lowest("low", 10), "total_": R.total("volume", 10)})
_columns("fx18_shift", {"s": O.lag("close", 3)}, lambda: {"s": R.shift("close", 3)})
_columns("fx19_change", {"ch": f"close - {O.lag('close', 2)}", "pc": f"close / {O.lag('close', 2)} - 1"}, lambda: {"ch": R.change("close", 2), "pc": R.pct_change("close", 2)})
_columns("fx20_zscore", {"z": f"(close - {O.roll('avg', 'close', 20)}) / nullif({O.roll('stddev_samp', 'close', 20)}, 0)"}, lambda: {"z": R.zscore("close", 20)})
_columns("fx21_normalize", {"z": f"(close - {O.roll('min', 'close', 20)}) / nullif({O.roll('max', 'close', 20)} - {O.roll('min', 'close', 20)}, 0)"}, lambda: {"z": R.normalize("close", 20)})
_columns("fx22_rank", {"k": f"CASE WHEN count(close) OVER {O.frame(9, 1)} = 9 THEN len(list_filter(list(close) OVER {O.frame(9, 1)}, lambda v: v < close)) / 9.0 END"}, lambda: {"k": R.rank("close", 10)})
_columns("fx25_math", {"a": "abs(d)", "l": "CASE WHEN d > 0 THEN ln(d) END", "q": "sqrt(CASE WHEN d < 0 THEN 0 ELSE d END)", "s": "sign(d)"}, lambda: {"a": F.abs("d"), "l": R.safe_log("d"), "q": R.safe_sqrt("d"), "s": F.signum("d")})
_columns("fx26_bounds", {"cl": "CASE WHEN d IS NOT NULL THEN greatest(least(d, 500), -500) END", "mx": "CASE WHEN d IS NOT NULL THEN greatest(d, close - open) END", "mn": "CASE WHEN d IS NOT NULL THEN least(d, close - open) END", "nz": "coalesce(d, 0)"}, lambda: {"cl": R.clip("d", -500.0, 500.0), "mx": R.both_max("d", c("close") - c("open")), "mn": R.both_min("d", c("close") - c("open")), "nz": F.coalesce("d", F.lit(0.0))})
_TY = "(high + low + close) / 3"
_columns("fx27_typical_vwap", {"t": _TY, "v": f"{O.roll('sum', f'({_TY}) * volume', 10)} / nullif({O.roll('sum', 'volume', 10)}, 0)"}, lambda: {"t": R.typical(), "v": R.vwap(10)})
_columns("fx28_obv", {"o": f"sum(coalesce(sign(d), 0) * volume) OVER ({O.W})"}, lambda: {"o": F.sum(F.coalesce(F.signum("d"), F.lit(0.0)) * c("volume")).over(R.so_far())})
_columns("fx24_where", {"w": "CASE WHEN d > 0 THEN high ELSE low END"}, lambda: {"w": F.when(c("d") > 0, c("high")).otherwise(c("low"))})
_columns("fx29_barssince", {"b": f"bar - last_value(CASE WHEN close > open THEN bar END IGNORE NULLS) OVER ({O.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, lambda: {"b": R.bars_since(c("close") > c("open"))})


@query("fx11_ema", f"{C},{O.ewm('candles', 'e', 'close', O.span(15), 'ema')} {sel('e', 'ema')}")
def fx11(spark, d):
    return out(I.ema(candles(spark, d), {"ema": 15}), "ema")


@query("fx12_rsi", f"{C}, {O.rsi('candles', 'x', 10)} {sel('x', 'rsi')}")
def fx12(spark, d):
    return out(I.rsi(candles(spark, d), 10), "rsi")


@query("fx13_macd", f"{C},{O.macd('candles')} {sel('mc', 'macd', 'macd_signal', 'macd_hist')}")
def fx13(spark, d):
    return out(I.macd(candles(spark, d)), "macd", "macd_signal", "macd_hist")


@query("fx14_bands", f"{C}, {O.bollinger('candles', 'b', 10, 2)} {sel('b', 'bb_upper', 'bb_mid', 'bb_lower')}")
def fx14(spark, d):
    return out(I.bollinger(candles(spark, d), 10), "bb_upper", "bb_mid", "bb_lower")


@query("fx15_atr", f"{C}, {O.atr('candles', 'a', 7)} {sel('a', 'atr')}")
def fx15(spark, d):
    return out(I.atr(candles(spark, d), 7), "atr")


@query("fx23_crosses", f"{C}, m AS (SELECT *, {O.roll('avg', 'close', 5)} AS a, {O.roll('avg', 'close', 20)} AS b FROM candles) SELECT symbol, time, coalesce(a > b AND {O.lag('a')} <= {O.lag('b')}, false) AS up, coalesce(a < b AND {O.lag('a')} >= {O.lag('b')}, false) AS down FROM m")
def fx23(spark, d):
    m = candles(spark, d).withColumns({"a": R.sma("close", 5), "b": R.sma("close", 20)})
    return m.select("symbol", "time", R.crossover("a", "b").alias("up"), R.crossunder("a", "b").alias("down"))


TEMPLATE_SQL = {
    "dip": (f"{O.roll('avg', 'gain', 14)} < 0.5 * {O.roll('avg', 'loss', 14)}", f"{O.roll('avg', 'gain', 14)} > 2 * {O.roll('avg', 'loss', 14)}"),
    "channel": (f"close > {O.prior('max', 'close', 20)}", f"close < {O.prior('min', 'close', 10)}"),
    "band": (f"close < {O.roll('avg', 'close', 20)} - 2 * {O.roll('stddev_samp', 'close', 20)}", f"close > {O.roll('avg', 'close', 20)}"),
    "trend": (f"close > {O.roll('avg', 'close', 60)}", f"close < {O.roll('avg', 'close', 60)}"),
}


def templates() -> dict:
    """Entry and exit conditions of the template strategies; bars have gain and loss."""
    mean, sd = R.sma("close", 20), R.std("close", 20)
    g, loss = R.sma("gain", 14), R.sma("loss", 14)
    return {
        "dip": (g < 0.5 * loss, g > 2 * loss),
        "channel": (c("close") > R.roll(F.max, "close", 20, R.prior_rows(20)), c("close") < R.roll(F.min, "close", 10, R.prior_rows(10))),
        "band": (c("close") < mean - 2 * sd, c("close") > mean),
        "trend": (c("close") > R.sma("close", 60), c("close") < R.sma("close", 60)),
    }


_TEMPLATES = ", ".join(f"{positions_sql('mv', *v, name=k, entry_wins=True)},{equity_sql(k, 10, name=k + '_q')}, {k}_r AS ({metrics_sql(k + '_q')})" for k, v in TEMPLATE_SQL.items())


@query("fx31_templates", f"{C}, {O.moves('candles', 'mv')}, {_TEMPLATES} " + " UNION ALL ".join(f"SELECT '{k}' AS template, * FROM {k}_r" for k in TEMPLATE_SQL))
def fx31(spark, d):
    df = I.moves(candles(spark, d))
    all_ = None
    for name, (enter, leave) in templates().items():
        one = B.metrics(B.equity(B.held(B.staged_regime(df, enter, leave, entry_wins=True)), 10)).withColumn("template", F.lit(name))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_


@query("fx05_formula_run", f"{C}, {O.moves('candles', 'mv')}, {positions_sql('mv', *TEMPLATE_SQL['trend'], name='p', entry_wins=True)}, l AS (SELECT *, {O.lag('position')} AS before FROM p) SELECT symbol, time, CASE WHEN position = 1 THEN 'entry' ELSE 'exit' END AS event FROM l WHERE position <> coalesce(before, 0)")
def fx05(spark, d):
    """Entry and exit dates of a formula's regime; an entry wins where both sides hold."""
    p = B.staged_regime(I.moves(candles(spark, d)), *templates()["trend"], entry_wins=True).withColumn("before", R.shift("position"))
    return p.where(c("position") != F.coalesce("before", F.lit(0))).select("symbol", "time", F.when(c("position") == 1, "entry").otherwise("exit").alias("event"))


@query("fx07_latest_result", "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, max(event_id) AS version FROM events GROUP BY 1, 2, 3")
def fx07(spark, d):
    """The newest stored result of a definition on each day: the one a same-day request would reuse."""
    from tidewell.sources.views import table

    e = table(spark, d, "events")
    return e.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("event_id").alias("version"))


#: User formulas, and the same in SQL over bars with row numbers.
USER = {
    "z": ("(close - mean(close, n)) / std(close, n)", f"(close - {O.roll('avg', 'close', 20)}) / nullif({O.roll('stddev_samp', 'close', 20)}, 0)"),
    "breakout": ("close / highest(shift(close, 1), 20) - 1", f"close / nullif({O.prior('max', 'close', 20)}, 0) - 1"),
    "picked": ("where(close > sma(close, 20) and not close < open, 1, 0) + nz(shift(close, 1) / close - 1)", f"CASE WHEN coalesce(close > {O.roll('avg', 'close', 20)}, false) AND NOT close < open THEN 1 ELSE 0 END + coalesce({O.lag('close')} / close - 1, 0)"),
    "bounded": ("clip(pct_change(close, 5), -0.05, 0.05) * 10 ** 2", f"CASE WHEN {O.lag('close', 5)} IS NOT NULL THEN greatest(least(close / {O.lag('close', 5)} - 1, 0.05), -0.05) * 100 END"),
    "index": ("zscore(obv(), 20)", f"(obv - {O.roll('avg', 'obv', 20)}) / nullif({O.roll('stddev_samp', 'obv', 20)}, 0)"),
}
CONDITIONS = {
    "calm": ("-300 < change(close) / 2 ** 2 < 300 or volume % 7 == 0", f"coalesce((close - {O.lag('close')}) / 4 > -300 AND (close - {O.lag('close')}) / 4 < 300, false) OR volume % 7 = 0"),
    "recent": ("barssince(close > open) <= m", f"coalesce(bar - last_value(CASE WHEN close > open THEN bar END IGNORE NULLS) OVER ({O.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 2, false)"),
    "other": ("(change(close, 2) != shift(close, 3)) | (close >= typical()) & True", f"coalesce(close - {O.lag('close', 2)} <> {O.lag('close', 3)}, true) OR close >= {_TY}"),
}
_SIGNED = f"mv AS (SELECT *, sum(coalesce(sign(close - before), 0) * volume) OVER ({O.W}) AS obv FROM (SELECT *, {O.lag('close')} AS before, row_number() OVER ({O.W}) AS bar FROM candles))"


def _compiled(spark, d, formulas, parameters):
    df = candles(spark, d)
    for name, (text, _) in formulas.items():
        df = X.with_formula(df, text, name, parameters)
    return df


@query("fx00_user_formulas", f"{C}, {_SIGNED} SELECT symbol, time, " + ", ".join(f"round({s}, 6) AS {n}" for n, (_, s) in USER.items()) + " FROM mv")
def fx00(spark, d):
    """Texts of formulas as columns: parameters, nested functions, powers and running sums."""
    return _compiled(spark, d, USER, {"n": 20}).select("symbol", "time", *[F.round(n, 6).alias(n) for n in USER])


@query("fx01_user_conditions", f"{C}, {_SIGNED} SELECT symbol, time, " + ", ".join(f"{s} AS {n}" for n, (_, s) in CONDITIONS.items()) + " FROM mv")
def fx01(spark, d):
    """Texts of conditions: chains of comparisons, both kinds of and and or, missing values."""
    return _compiled(spark, d, CONDITIONS, {"m": 2}).select("symbol", "time", *CONDITIONS)


@query("fx02_user_positions", f"{C}, {O.moves('candles', 'mv')}, {positions_sql('mv', *TEMPLATE_SQL['trend'], name='p', entry_wins=True)} SELECT symbol, time, position FROM p")
def fx02(spark, d):
    """The trend template from its text: validated, compiled and held."""
    return X.run(candles(spark, d), "close / sma(close, n) - 1", "close > sma(close, n)", "close < sma(close, n)", {"n": 60}).select("symbol", "time", "position")
