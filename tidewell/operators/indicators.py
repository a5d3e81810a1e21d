"""Technical indicators as columns added to bars (symbol, time, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import rolling as R

from .ordered import ewm, fold


def clean(df: DataFrame) -> DataFrame:
    """Bars from raw text or numbers: prices cast, gaps filled forward, then backward, rows with close > 0 kept.

    `time` in epoch seconds becomes a timestamp. Values that are no numbers count as gaps.
    """
    fields = ("open", "high", "low", "close", "volume")
    df = df.select("symbol", F.timestamp_seconds(F.col("time")).alias("time"), *[F.col(c).try_cast("double").alias(c) for c in fields])
    ahead = R.order().rowsBetween(0, R.Window.unboundedFollowing)
    df = df.select("symbol", "time", *[F.last(c, ignorenulls=True).over(R.so_far()).alias(c) for c in fields])
    return df.select("symbol", "time", *[F.first(c, ignorenulls=True).over(ahead).alias(c) for c in fields]).where("close > 0")


def moves(df: DataFrame, x: str = "close") -> DataFrame:
    """df with gain and loss of x against the row before (null in a key's first row)."""
    return df.withColumn("_d", R.change(x)).withColumns({"gain": F.greatest("_d", F.lit(0.0)), "loss": F.greatest(-F.col("_d"), F.lit(0.0))}).withColumns({c: F.when(F.col("_d").isNotNull(), F.col(c)) for c in ("gain", "loss")}).drop("_d")


def rsi(df: DataFrame, n: int = 14, x: str = "close", out: str = "rsi") -> DataFrame:
    """Relative strength over simple means; null where the mean loss is 0."""
    ratio = R.sma("gain", n) / R.nonzero(R.sma("loss", n))
    return moves(df, x).withColumn(out, 100 - 100 / (1 + ratio)).drop("gain", "loss")


def rsi_wilder(df: DataFrame, n: int = 14, x: str = "close", out: str = "rsi") -> DataFrame:
    """Relative strength over exponential means with alpha 1 / n, from the first change on."""
    smooth = ewm(moves(df, x), {"_g": ("gain", 1 / n), "_l": ("loss", 1 / n)})
    return smooth.withColumn(out, 100 - 100 / (1 + F.col("_g") / R.nonzero(F.col("_l")))).drop("gain", "loss", "_g", "_l")


def rsi_seeded(df: DataFrame, n: int = 14, x: str = "close", out: str = "rsi") -> DataFrame:
    """Relative strength seeded with simple means of n changes, then smoothed; a ratio of 100 where nothing was lost."""

    def segment(state, rows):
        seen, gains, losses = state or (0, 0.0, 0.0)
        values = []
        for gain, loss in zip(rows["gain"], rows["loss"], strict=True):
            if gain == gain:
                seen += 1
                if seen <= n:
                    gains, losses = gains + gain, losses + loss
                    if seen == n:
                        gains, losses = gains / n, losses / n
                else:
                    gains, losses = (gains * (n - 1) + gain) / n, (losses * (n - 1) + loss) / n
            values.append(None if seen < n else 100 - 100 / (1 + (gains / losses if losses > 0 else 100)))
        return (seen, gains, losses), rows.assign(**{out: values})

    return fold(moves(df, x), ["symbol"], ["time"], f"{out} double", segment).drop("gain", "loss")


def ema(df: DataFrame, spans: dict[str, int], x: str = "close") -> DataFrame:
    """Exponential means by span, seeded with the first value."""
    return ewm(df, {name: (x, 2 / (span + 1)) for name, span in spans.items()})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> DataFrame:
    """df with macd, macd_signal and macd_hist, from one pass over each symbol."""
    alpha = lambda span: 2 / (span + 1)
    steps = {"_fast": (x, alpha(fast)), "_slow": (x, alpha(slow)), "macd": lambda rows: rows["_fast"] - rows["_slow"], "macd_signal": ("macd", alpha(signal))}
    return ewm(df, steps).drop("_fast", "_slow").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, x: str = "close", population: bool = False) -> DataFrame:
    """df with bb_mid, bb_upper and bb_lower: k sample (or population) deviations around the mean."""
    spread = R.roll(F.stddev_pop, x, n) if population else R.std(x, n)
    df = df.withColumns({"bb_mid": R.sma(x, n), "_sd": spread})
    return df.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_sd"), "bb_lower": F.col("bb_mid") - k * F.col("_sd")}).drop("_sd")


def true_range(df: DataFrame, out: str = "tr") -> DataFrame:
    """The first bar of a key has no close before it; its range is high - low."""
    before = R.shift("close")
    return df.withColumn(out, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    return true_range(df, "_tr").withColumn(out, R.sma("_tr", n)).drop("_tr")


def features(df: DataFrame) -> DataFrame:
    """Model features of each bar and the class of its next five bars; bars without all features go.

    The class is 1 above +2 %, -1 below -2 % and 0 else, also where the future is missing.
    """
    df = bollinger(atr(rsi(macd(df))))
    width = R.nonzero(F.col("bb_upper") - F.col("bb_lower"))
    future = F.try_divide(F.lead("close", 5).over(R.order()), F.col("close")) - 1
    df = df.withColumns({
        "ret_1": R.pct_change("close", 1), "ret_5": R.pct_change("close", 5), "ret_20": R.pct_change("close", 20),
        "ma5_ratio": F.col("close") / R.nonzero(R.sma("close", 5)), "ma20_ratio": F.col("close") / R.nonzero(R.sma("close", 20)),
        "bb_width": width / R.nonzero(F.col("bb_mid")), "bb_pos": (F.col("close") - F.col("bb_lower")) / width,
        "vol_ratio": F.col("volume") / R.nonzero(R.sma("volume", 20)),
        "target": F.when(future > 0.02, 1).when(future < -0.02, -1).otherwise(0),
    })
    return df.dropna(subset=list(FEATURES))


FEATURES = ("ret_1", "ret_5", "ret_20", "ma5_ratio", "ma20_ratio", "rsi", "macd", "macd_hist", "bb_width", "bb_pos", "vol_ratio", "atr")


def rule_signal() -> Column:
    """Signal of one bar of features: 1 at a score of 3, -1 at -3, else 0."""
    point = lambda up, down, w=1: F.when(up, w).when(down, -w).otherwise(0)
    c = F.col
    score = point(c("rsi") < 30, c("rsi") > 70, 2) + point(c("macd_hist") > 0, c("macd_hist") < 0) + point(c("bb_pos") < 0.1, c("bb_pos") > 0.9) + point(c("ma5_ratio") > c("ma20_ratio"), c("ma5_ratio") < c("ma20_ratio"))
    return F.when(score >= 3, 1).when(score <= -3, -1).otherwise(0)


def research(df: DataFrame) -> DataFrame:
    """The frame that strategies and screens read: moving means, Wilder strength, MACD, bands, mean volume."""
    df = bollinger(macd(rsi_wilder(df)))
    return df.withColumns({"ma5": R.sma("close", 5), "ma20": R.sma("close", 20), "ma60": R.sma("close", 60), "volume_ma20": R.sma("volume", 20)})


def gate_features(df: DataFrame) -> DataFrame:
    """Scale-free state of a bar before an entry: returns in percent, volatility regime, volume, place and slope."""
    df = atr(atr(df, 14, "atr14"), 240, "_atr240")
    df = ema(df.withColumn("_log", F.ln("close")), {"_ema60": 60})
    prior = R.prior_rows(60)
    mean, sd = R.roll(F.avg, "volume", 60, prior), R.roll(F.stddev_samp, "volume", 60, prior)
    low, high = R.lowest("low", 240), R.highest("high", 240)
    df = df.withColumns({
        **{f"ret_{n}": R.change("_log", n) * 100 for n in (1, 5, 15, 60)},
        "atr_regime": F.col("atr14") / R.nonzero(F.col("_atr240")), "volume_z": (F.col("volume") - mean) / R.nonzero(sd),
        "taker_ratio": F.col("taker") / R.nonzero(F.col("volume")), "range_pos_240": (F.col("close") - low) / R.nonzero(high - low),
        "trend_slope": R.change("_ema60", 15) / R.nonzero(F.col("atr14")),
    })
    return df.drop("_atr240", "_log", "_ema60")


def last_bar(df: DataFrame, n: int = 1) -> DataFrame:
    """The last n bars of each symbol."""
    back = F.row_number().over(R.Window.partitionBy("symbol").orderBy(F.desc("time")))
    return df.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")
