"""Breakout event study: fresh channel breakouts, exits, labels and rule statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import rolling as R

from .ordered import by_row, fold

STOP, TAKE, MOST_BARS, GAP_CAP = 2.0, 3.0, 24, 240


def signals(df: DataFrame, n: int) -> DataFrame:
    """Bars whose close lies above the prior n highs when the bar before did not.

    df has atr14. Adds bar (0-based), channel, margin and gap, the bars since the last
    signal, capped; gaps are taken before any bar is left out for missing features.
    """
    df = df.withColumns({"bar": F.row_number().over(R.order()) - 1, "channel": R.roll(F.max, "high", n, R.prior_rows(n))})
    df = df.withColumn("_above", F.coalesce(F.col("close") > F.col("channel"), F.lit(False)))
    df = df.withColumn("_fresh", F.col("_above") & ~F.coalesce(R.shift("_above"), F.lit(False)))
    found = df.where("_fresh").withColumn("gap", F.least(F.lit(GAP_CAP), F.coalesce(R.change("bar"), F.lit(GAP_CAP))))
    return found.withColumn("margin", (F.col("close") - F.col("channel")) / R.nonzero(F.col("atr14"))).drop("_above", "_fresh")


def with_paths(df: DataFrame) -> DataFrame:
    """df with path, the closes of the next MOST_BARS bars: what an exit decided at this bar's close can see."""
    return df.withColumn("path", F.collect_list("close").over(R.order().rowsBetween(1, MOST_BARS)))


def exits(entry: Column, atr: Column, path: Column) -> Column:
    """Struct (steps, reason, price): the first close at the stop or the take, else time, else the data's end."""
    low, high = entry - STOP * atr, entry + TAKE * atr
    # No window or outer column is rebuilt per element: the limits travel in the path's structs.
    marked = F.transform(path, lambda x, i: F.struct(F.when(x <= low, F.lit("stop")).when(x >= high, F.lit("take")).alias("reason"), x.alias("price"), (i + 1).alias("steps")))
    first = F.get(F.filter(marked, lambda m: m["reason"].isNotNull()), F.lit(0))
    last = F.struct(F.when(F.size(path) == MOST_BARS, F.lit("time")).otherwise(F.lit("end")).alias("reason"), F.element_at(path, -1).alias("price"), F.size(path).alias("steps"))
    return F.coalesce(first, F.when(F.size(path) > 0, last))


def net_return(entry: Column, leave: Column, fee: float, slip_bps: float) -> Column:
    slip = slip_bps / 10_000
    return leave * (1 - slip) / (entry * (1 + slip)) * (1 - fee) ** 2 - 1


def one_at_a_time(found: DataFrame) -> DataFrame:
    """Signals taken when no earlier taken one is still open; found has bar and exit_bar."""

    def step(busy, row):
        free = busy is None or row.bar > busy
        return (row.exit_bar if free else busy), (bool(free),)

    return fold(found, ["symbol"], ["bar"], "taken boolean", by_row(step, ["taken"])).where("taken").drop("taken")


def trades(df: DataFrame, n: int, fee: float, slip_bps: float, single: bool = True) -> DataFrame:
    """Trades at the signal's close: symbol, bar, exit_bar, reason, gross and net."""
    found = signals(with_paths(df), n).where("atr14 is not null").withColumn("x", exits(F.col("close"), F.col("atr14"), F.col("path"))).where("x is not null")
    found = found.withColumn("exit_bar", F.col("bar") + F.col("x.steps"))
    rows = found.select("symbol", "time", F.col("bar").cast("long").alias("bar"), F.col("exit_bar").cast("long").alias("exit_bar"), F.col("x.reason").alias("reason"), (F.col("x.price") / F.col("close") - 1).alias("gross"), net_return(F.col("close"), F.col("x.price"), fee, slip_bps).alias("net"))
    return one_at_a_time(rows) if single else rows


def events(df: DataFrame, n: int, fee: float, slip_bps: float, features: tuple[str, ...], bar: str = "1 HOUR") -> DataFrame:
    """Labelled events: entry at the next bar's open, exit at the open after the exit bar; both must follow without a gap.

    label is 1 where the net return is below 0. state holds the features to three decimals.
    """
    width = F.expr(f"INTERVAL {bar}")
    ahead = R.order().rowsBetween(2, MOST_BARS + 2)
    seen = df.withColumns({
        "_next": F.lead("time").over(R.order()), "_entry": F.lead("open").over(R.order()),
        "_after": F.collect_list(F.struct("open", "time")).over(ahead), "path": F.collect_list("close").over(R.order().rowsBetween(1, MOST_BARS)),
        "_times": F.collect_list("time").over(R.order().rowsBetween(1, MOST_BARS)),
    })
    found = signals(seen, n).dropna(subset=list(features)).where(F.col("_next") == F.col("time") + width)
    found = found.withColumn("x", exits(F.col("_entry"), F.col("atr14"), F.col("path"))).where("x.reason <> 'end'")
    found = found.withColumns({"_out": F.get("_after", F.col("x.steps") - 1), "_at": F.get("_times", F.col("x.steps") - 1)}).where(F.col("_out.time") == F.col("_at") + width)
    net = net_return(F.col("_entry"), F.col("_out.open"), fee, slip_bps)
    state = F.struct(*[F.round(c, 3).alias(c) for c in features])
    return found.select("symbol", "time", F.col("bar").cast("long").alias("bar"), "gap", F.col("x.reason").alias("reason"), net.alias("net"), (net < 0).cast("int").alias("label"), state.alias("state"), F.sha2(F.to_json(state), 256).alias("state_key"))


def rule_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, compound return, mean, win rate and counts of reasons of trades."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.product(1 + F.col("net")) - 1).alias("compound"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("stop", "take", "time", "end")],
    )
