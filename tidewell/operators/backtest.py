"""Positions, stops and cost-aware backtests over bars, one row sequence for each symbol.

A frame with a column `position` (0 or 1, decided at the bar's close) goes through
held() -> stops() -> equity() -> metrics(). Costs are charged on turnover in basis points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import rolling as R

from .ordered import by_row, fold


def held(df: DataFrame) -> DataFrame:
    """df with ret (0 in the first bar) and held: a position earns from the bar after its decision."""
    return df.withColumns({"ret": F.coalesce(R.pct_change("close"), F.lit(0.0)), "held": F.coalesce((R.shift("position") == 1).cast("double"), F.lit(0.0))})


def stops(df: DataFrame, stop_loss: float | None = None, take_profit: float | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """df with held put to 0 after a stop or a take, and their marks stop_hit and take_hit (0 or 1).

    The entry price is the close before the first held bar. The bar that hits keeps its
    return; the position stays closed until held rises from 0 to 1 again. Limits are shares.
    """

    def step(state, row):
        entry, blocked, before, last = state or (None, False, 0.0, None)
        wants = row.held == 1
        if wants and before == 0:
            blocked = False
        out, hit_stop, hit_take = 0.0, 0, 0
        if not wants or blocked:
            entry = None
        else:
            if entry is None:
                entry = row.close if last is None else last
            out = 1.0
            if stop_loss and row.close <= entry * (1 - stop_loss):
                hit_stop, blocked, entry = 1, True, None
            elif take_profit and row.close >= entry * (1 + take_profit):
                hit_take, blocked, entry = 1, True, None
        return (entry, blocked, row.held, row.close), (out, hit_stop, hit_take)

    names = ["held_after", "stop_hit", "take_hit"]
    out = fold(df, list(keys), ["time"], "held_after double, stop_hit int, take_hit int", by_row(step, names))
    return out.drop("held").withColumnRenamed("held_after", "held")


def equity(df: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """df with turnover, cost, net and the growth of strategy (eq), gross (gross_eq) and holding (hold_eq)."""
    change = F.col("held") - F.coalesce(R.shift("held"), F.lit(0.0))
    df = df.withColumn("turnover", F.abs(change)).withColumn("cost", F.col("turnover") * (cost_bps / 10_000))
    df = df.withColumn("net", F.col("ret") * F.col("held") - F.col("cost"))
    grow = lambda x: F.product(1 + x).over(R.so_far())
    df = df.withColumns({"eq": grow(F.col("net")), "gross_eq": grow(F.col("ret") * F.col("held")), "hold_eq": grow(F.col("ret"))})
    return df.withColumns({"drawdown": F.col("eq") / F.max("eq").over(R.so_far()) - 1, "first_bar": F.row_number().over(R.order()) == 1})


def metrics(df: DataFrame, count_first: bool = False, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each key: returns and costs in percent, ratio, drawdown, trades and share of winning held bars."""
    last = lambda c: F.max_by(c, "time")
    trades = F.count_if((F.col("turnover") > 0) if count_first else (F.col("turnover") > 0) & ~F.col("first_bar"))
    ratio = F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0))
    wins = F.try_divide(F.count_if((F.col("held") == 1) & (F.col("net") > 0)), F.count_if(F.col("held") == 1))
    return df.groupBy(*keys).agg(
        F.round((last("eq") - 1) * 100, 4).alias("total_return"), F.round((last("gross_eq") - 1) * 100, 4).alias("gross_return"), F.round((last("hold_eq") - 1) * 100, 4).alias("hold_return"),
        F.round(F.sum("cost") * 100, 4).alias("cost"), F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("sharpe"), F.round(F.min("drawdown") * 100, 4).alias("mdd"),
        trades.alias("trades"), F.round(F.coalesce(wins, F.lit(0.0)) * 100, 4).alias("win_rate"),
    )


def strategy_position(df: DataFrame, strategy: str) -> DataFrame:
    """research() bars with the position of a preset: rsi, ma, bollinger or composite."""
    c = F.col
    rules = {
        "rsi": (c("rsi") < 30, c("rsi") > 70),
        "ma": (R.crossover("ma5", "ma20"), R.crossunder("ma5", "ma20")),
        "bollinger": (c("close") < c("bb_lower"), c("close") > c("bb_upper")),
        "composite": ((c("ma5") > c("ma20")) & (c("rsi") > 50) & (c("macd") > c("macd_signal")), (c("ma5") < c("ma20")) | (c("rsi") > 75)),
    }
    return staged_regime(df, *rules[strategy])


def staged_regime(df: DataFrame, enter: Column, leave: Column, entry_wins: bool = False) -> DataFrame:
    """df with position; conditions may use windows, so they are columns before the regime's window reads them."""
    df = df.withColumns({"_in": enter, "_out": leave})
    return df.withColumn("position", R.regime("_in", "_out", entry_wins)).drop("_in", "_out")


def custom_position(df: DataFrame, base: str, short: int = 5, mid: int = 20, buy: float = 35.0) -> DataFrame:
    """Bars with rsi, MACD and bands, and the position of a parametrised strategy."""
    short, buy = max(2, short), max(5.0, min(50.0, buy))
    mid = max(short + 1, mid)
    c, sell = F.col, 100 - buy
    df = df.withColumns({"_s": R.sma("close", short), "_m": R.sma("close", mid), "_long": R.sma("close", max(2 * mid, mid + 1)), "_vol": R.sma("volume", mid)})
    up, down = R.crossover("_s", "_m"), R.crossunder("_s", "_m")
    rules = {
        "rsi_ma": (up & (c("rsi") < buy), down | (c("rsi") > sell)),
        "macd_bb": (R.crossover("macd", "macd_signal") & (c("close") < c("bb_mid")), R.crossunder("macd", "macd_signal") | (c("close") > c("bb_upper"))),
        "volume_rsi": ((c("rsi") < buy) & (c("volume") > c("_vol")), c("rsi") > sell),
        "triple_ma": (up & (c("_m") > c("_long")), down | (c("_m") < c("_long"))),
    }
    return staged_regime(df, *rules[base]).drop("_s", "_m", "_long", "_vol")


def lagged_level(df: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """held = 1 in bars after a bar whose short mean lies above the long one."""
    df = df.withColumn("_up", F.coalesce((R.sma("close", short) > R.sma("close", long)).cast("double"), F.lit(0.0)))
    return df.withColumn("held", F.coalesce(R.shift("_up"), F.lit(0.0))).drop("_up")


def momentum(df: DataFrame, n: int = 20) -> DataFrame:
    """held from the bar after a close above the prior n highs until the bar after one below the prior n lows."""
    high, low = R.roll(F.max, "close", n, R.prior_rows(n)), R.roll(F.min, "close", n, R.prior_rows(n))
    df = staged_regime(df, F.coalesce(F.col("close") > high, F.lit(False)), F.coalesce(F.col("close") < low, F.lit(False)))
    return df.withColumn("held", F.coalesce(R.shift("position"), F.lit(0)).cast("double"))


def instalments(df: DataFrame, every: int = 21) -> DataFrame:
    """df with eq of equal sums spent on every k-th bar, the rest in cash."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    df = df.withColumns({"_i": F.row_number().over(R.order()) - 1, "_n": n})
    buys = ((F.col("_n") - 1) / every).cast("long") + 1
    df = df.withColumn("_share", 1.0 / buys).withColumn("_buy", (F.col("_i") % every == 0) & (F.col("close") > 0))
    shares = F.sum(F.when(F.col("_buy"), F.col("_share") / F.col("close")).otherwise(0.0)).over(R.so_far())
    cash = 1.0 - F.sum(F.when(F.col("_buy"), F.col("_share")).otherwise(0.0)).over(R.so_far())
    return df.withColumn("eq", shares * F.col("close") + cash).drop("_i", "_n", "_share", "_buy")


def annual(df: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """Yearly growth, population volatility, ratio over a risk-free rate, invested share and changes per symbol.

    df has eq and held; a change above 0.001 counts, the first bar's holding included.
    """
    df = df.withColumns({"_r": F.try_divide("eq", R.shift("eq")) - 1, "_d": F.abs(F.col("held") - F.coalesce(R.shift("held"), F.lit(0.0)))})
    years = (F.count("*") - 1) / 252.0
    growth = (F.pow(F.max_by("eq", "time") / F.min_by("eq", "time"), 1 / years) - 1) * 100
    out = df.groupBy("symbol").agg(growth.alias("growth"), (F.coalesce(F.stddev_pop("_r"), F.lit(0.0)) * F.sqrt(F.lit(252.0)) * 100).alias("vol"), (F.avg("held") * 100).alias("invested"), F.count_if(F.col("_d") > 0.001).alias("changes"))
    ratio = F.coalesce(F.try_divide(F.col("growth") / 100 - risk_free, F.col("vol") / 100), F.lit(0.0))
    return out.select("symbol", F.round("growth", 4).alias("growth"), F.round("vol", 4).alias("volatility"), F.round(ratio, 4).alias("sharpe"), F.round("invested", 4).alias("invested"), "changes")


def warm_up_days(strategy: str, long_window: int = 60, breakout_window: int = 20) -> int:
    """Calendar days before the first one asked for that a strategy's windows need: twice their bars and a margin."""
    return {"ma_cross": 2 * long_window + 15, "momentum": 2 * breakout_window + 15}.get(strategy, 0)


def warmed(bars: DataFrame, strategy: str, first_day: Column, long_window: int = 60, breakout_window: int = 20) -> DataFrame:
    """bars from the warm-up of a strategy on, with asked: whether they belong to the time asked for."""
    from_day = F.date_sub(first_day, warm_up_days(strategy, long_window, breakout_window))
    return bars.where(F.to_date("time") >= from_day).withColumn("asked", F.to_date("time") >= first_day)
