"""Rolling column functions over bars. All see the past only and share one window per key."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .definitions import period

Name = Column | str


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order(key: str = "symbol", time: str = "time") -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def last_rows(n: int) -> WindowSpec:
    return order().rowsBetween(1 - n, 0)


def prior_rows(n: int) -> WindowSpec:
    return order().rowsBetween(-n, -1)


def so_far() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def roll(function, x: Name, n: int, frame: WindowSpec | None = None) -> Column:
    """function over the last n rows; null until n of them have a value."""
    frame = frame or last_rows(period(n))
    return F.when(F.count(col(x)).over(frame) == n, function(col(x)).over(frame))


def sma(x: Name, n: int) -> Column:
    return roll(F.avg, x, n)


def std(x: Name, n: int) -> Column:
    return roll(F.stddev_samp, x, n)


def highest(x: Name, n: int) -> Column:
    return roll(F.max, x, n)


def lowest(x: Name, n: int) -> Column:
    return roll(F.min, x, n)


def total(x: Name, n: int) -> Column:
    return roll(F.sum, x, n)


def shift(x: Name, n: int = 1) -> Column:
    if n < 1:
        raise ValueError("a shift below 1 would look ahead")
    return F.lag(col(x), n).over(order())


def change(x: Name, n: int = 1) -> Column:
    return col(x) - shift(x, n)


def pct_change(x: Name, n: int = 1) -> Column:
    return F.try_divide(col(x), shift(x, n)) - 1


def nonzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def zscore(x: Name, n: int) -> Column:
    return (col(x) - sma(x, n)) / nonzero(std(x, n))


def normalize(x: Name, n: int) -> Column:
    return (col(x) - lowest(x, n)) / nonzero(highest(x, n) - lowest(x, n))


def rank(x: Name, n: int) -> Column:
    """Share of the n - 1 values before that lie strictly below the current one."""
    before = F.collect_list(col(x)).over(prior_rows(n - 1))
    return F.when(F.size(before) == n - 1, F.size(F.filter(before, lambda v: v < col(x))) / F.lit(n - 1.0))


def crossover(a: Name, b: Name) -> Column:
    return F.coalesce((col(a) > col(b)) & (shift(a) <= shift(b)), F.lit(False))


def crossunder(a: Name, b: Name) -> Column:
    return F.coalesce((col(a) < col(b)) & (shift(a) >= shift(b)), F.lit(False))


def safe_log(x: Name) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def safe_sqrt(x: Name) -> Column:
    return F.sqrt(F.when(col(x) < 0, 0.0).otherwise(col(x)))


def both_max(a: Name, b: Name) -> Column:
    """The larger value; null where either is null."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a), col(b)))


def both_min(a: Name, b: Name) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))


def clip(x: Name, low: float, high: float) -> Column:
    return both_max(both_min(x, F.lit(high)), F.lit(low))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(n: int) -> Column:
    return total(typical() * F.col("volume"), n) / nonzero(total("volume", n))


def bars_since(condition: Name) -> Column:
    """Rows since the condition last held; null before it first did. Needs the row number column `bar`."""
    return F.col("bar") - F.last(F.when(col(condition), F.col("bar")), ignorenulls=True).over(so_far())


def regime(enter: Name, leave: Name, entry_wins: bool = False) -> Column:
    """1 from an entry on, 0 from an exit on, 0 at first; one side wins where both hold."""
    first, second = ((enter, 1), (leave, 0)) if entry_wins else ((leave, 0), (enter, 1))
    event = F.when(col(first[0]), first[1]).when(col(second[0]), second[1])
    return F.coalesce(F.last(event, ignorenulls=True).over(so_far()), F.lit(0))
