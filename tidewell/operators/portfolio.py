"""Ledgers, valuation, rebalancing, limits and goal simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import by_row, fold

c = F.col


def apply_fills(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """fills (side, qty, price) with pos_qty and pos_avg after each: average cost on buys, sales capped by the holding, a full exit clears."""

    def step(state, row):
        qty, avg = state or (0, 0.0)
        if row.side == "BUY":
            avg = (qty * avg + row.qty * row.price) / (qty + row.qty)
            qty += row.qty
        else:
            qty -= min(qty, row.qty)
            avg = avg if qty else 0.0
        return (qty, avg), (int(qty), float(avg))

    return fold(fills, keys, order, "pos_qty long, pos_avg double", by_row(step, ["pos_qty", "pos_avg"]))


def apply_cost_basis(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """fills of fractional quantities with pos_qty (8 decimals) and basis, which a sale reduces in proportion."""

    def step(state, row):
        qty, basis = state or (0.0, 0.0)
        if row.side == "BUY":
            qty, basis = round(qty + row.qty, 8), round(basis + row.qty * row.price, 2)
        else:
            sold = min(qty, row.qty)
            basis = round(basis * (1 - sold / qty), 2) if qty else 0.0
            qty = round(qty - sold, 8)
        return (qty, basis), (float(qty), float(basis))

    return fold(fills, keys, order, "pos_qty double, basis double", by_row(step, ["pos_qty", "basis"]))


def value(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    """holdings with price (the average cost where no quote is known), value, profit and rate in percent."""
    df = holdings.join(quotes, "symbol", "left").withColumn("price", F.coalesce("price", "avg_price"))
    df = df.withColumns({"value": c("qty") * c("price"), "profit": c("qty") * (c("price") - c("avg_price"))})
    return df.withColumn("rate", F.coalesce(F.try_divide(c("price") - c("avg_price"), c("avg_price")) * 100, F.lit(0.0)))


def snapshot(targets: DataFrame, holdings: DataFrame, user: str = "user") -> DataFrame:
    """Weight, target weight and drift of every target and held symbol of each user, in percent of the user's equity.

    holdings has user, symbol and value, targets symbol and weight; cash is a symbol like others.
    """
    everyone = holdings.select(user).distinct()
    full = everyone.crossJoin(F.broadcast(targets)).join(holdings.select(user, "symbol", "value"), [user, "symbol"], "full_outer")
    full = full.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "value": F.coalesce("value", F.lit(0.0))})
    equity = F.sum("value").over(Window.partitionBy(user))
    full = full.withColumn("actual", F.coalesce(F.try_divide(c("value"), equity) * 100, F.lit(0.0))).withColumn("equity", equity)
    full = full.withColumn("drift", c("actual") - c("weight"))
    return full.withColumn("max_drift", F.max(F.abs("drift")).over(Window.partitionBy(user)))


def proposals(snap: DataFrame, quotes: DataFrame, min_order: float) -> DataFrame:
    """side and quantity that bring each symbol to its target; small differences are left, sales end at the holding."""
    df = snap.join(quotes, "symbol").withColumn("diff", c("equity") * c("weight") / 100 - c("value"))
    df = df.where(F.abs("diff") >= F.greatest(c("price"), F.lit(min_order)))
    qty = F.floor(F.abs("diff") / c("price"))
    held = F.floor(c("value") / c("price"))
    return df.withColumns({"side": F.when(c("diff") > 0, "BUY").otherwise("SELL"), "qty": F.when(c("diff") > 0, qty).otherwise(F.least(qty, held)).cast("long")}).where("qty > 0")


def fund_buys(orders: DataFrame, cash: DataFrame, user: str = "user") -> DataFrame:
    """orders with filled: sales in full; buys in order of size take what cash and sales leave, the last in part."""
    df = orders.join(cash, user).withColumns({"_r": (c("side") == "BUY").cast("int"), "_a": -c("qty") * c("price")})

    def step(left, row):
        left = row.cash if left is None else left
        if row.side == "SELL":
            return left + row.qty * row.price, (int(row.qty),)
        filled = min(int(row.qty), int(left // row.price)) if left > 0 else 0
        return left - filled * row.price, (filled,)

    return fold(df, [user], ["_r", "_a", "symbol"], "filled long", by_row(step, ["filled"])).drop("_r", "_a")


def next_period(day: Column, period: str) -> Column:
    """First day of the next month, quarter or year."""
    return F.add_months(F.trunc(day, period), {"month": 1, "quarter": 3, "year": 12}[period])


def cooled(orders: DataFrame, keys: list[str], time: str, tie: str, seconds: int) -> DataFrame:
    """orders with taken: whether no order of the key was taken within the seconds before."""

    def step(last, row):
        now = getattr(row, time)
        free = last is None or (now - last).total_seconds() >= seconds
        return (now if free else last), (bool(free),)

    return fold(orders, keys, [time, tie], "taken boolean", by_row(step, ["taken"]))


def buy_cap(qty: Column, price: Column, held: Column, equity: Column, percent: float) -> Column:
    """Quantity of a buy that keeps the position within a share of the equity."""
    room = F.floor(F.try_divide(equity * percent / 100 - held, price))
    return F.greatest(F.least(qty, room), F.lit(0)).cast("long")


#: Symbols in a block of the matrix, and days in a block of one of its products.
BLOCK_SYMBOLS, BLOCK_DAYS = 64, 256


def covariances(returns: DataFrame, symbols: int = BLOCK_SYMBOLS, days: int = BLOCK_DAYS) -> DataFrame:
    """symbol, other, cov and n of all pairs of symbols over their common times; returns: symbol, time, ret, a row for each.

    A blocked Gram matrix: symbols and times fall into blocks, a task multiplies two
    blocks of symbols over one block of times, and the sums of the products are added up.
    So a row is sent once for each block of symbols and not once for each symbol, and a
    task holds two blocks. Times with a null return count as missing.
    """
    known = returns.where("ret is not null").select("symbol", "time", c("ret").cast("double").alias("ret"))
    sizes = known.agg(F.count_distinct("symbol").alias("s"), F.count_distinct("time").alias("t")).first()
    across, along = max(1, -(-sizes["s"] // symbols)), max(1, -(-sizes["t"] // days))
    block = F.pmod(F.xxhash64("symbol"), F.lit(across)).cast("int")
    placed = known.withColumns({"_b": block, "_t": F.pmod(F.xxhash64("time"), F.lit(along)).cast("int")})
    others = F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    sent = placed.withColumn("_p", F.explode(others)).select("symbol", "time", "ret", "_b", "_t", c("_p.i").alias("_i"), c("_p.j").alias("_j"))

    def products(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = key
        wide = {k: rows[rows["_b"] == k].pivot(index="symbol", columns="time", values="ret") for k in {i, j}}
        times = sorted(set(rows["time"]))
        a, b = (wide[k].reindex(columns=times) for k in (i, j))
        x, y, m, w = a.fillna(0).to_numpy(), b.fillna(0).to_numpy(), a.notna().to_numpy(float), b.notna().to_numpy(float)
        n = m @ w.T
        r, k = np.nonzero(np.triu(n) if i == j else n)  # a pair of one block once
        sums = {"n": n, "x": x @ w.T, "y": m @ y.T, "xy": x @ y.T}
        return pd.DataFrame({"symbol": a.index.to_numpy()[r], "other": b.index.to_numpy()[k]} | {name: v[r, k] for name, v in sums.items()})

    kind = returns.schema["symbol"].dataType.simpleString()
    parts = sent.groupBy("_i", "_j", "_t").applyInPandas(products, f"symbol {kind}, other {kind}, n double, x double, y double, xy double")
    both = parts.where("symbol <= other").unionByName(parts.where("symbol > other").select(c("other").alias("symbol"), c("symbol").alias("other"), "n", c("y").alias("x"), c("x").alias("y"), "xy"))
    once = both.groupBy("symbol", "other").agg(*(F.sum(f).alias(f) for f in ("n", "x", "y", "xy")))
    cov = F.when(c("n") > 1, (c("xy") - c("x") * c("y") / c("n")) / (c("n") - 1))
    half = once.select("symbol", "other", cov.alias("cov"), c("n").cast("long").alias("n"))
    return half.unionByName(half.where("symbol <> other").select(c("other").alias("symbol"), c("symbol").alias("other"), "cov", "n"))


def allocate(returns: DataFrame, days: int = 756, prior: float = 0.07, most: int = 500) -> DataFrame:
    """symbol, weight, expected and volatility of a long-only blend of least variance and shrunk means.

    Means and covariances of common dates are aggregated by Spark; the matrix has a row
    for each symbol of a chosen universe, of at most `most` symbols, and is solved on the driver;
    a larger one is an error. Weights stay in 5 % to 60 % before they are scaled to 1.
    """
    spark = returns.sparkSession
    n = returns.select("symbol").distinct().count()
    if n > most:
        raise ValueError(f"a universe of {n} symbols is more than the {most} that one matrix is solved for")
    common = returns.groupBy("time").agg(F.count("*").alias("k")).where(c("k") == n).select("time").orderBy(F.desc("time")).limit(days)
    rows = returns.join(common, "time", "left_semi").select("time", "symbol", "ret")
    pairs = covariances(rows).join(rows.groupBy("symbol").agg(F.avg("ret").alias("mean")), "symbol")
    found = pairs.toPandas()
    if found.empty:
        return spark.createDataFrame([], "symbol string, weight double, expected double, volatility double")
    matrix = found.pivot(index="symbol", columns="other", values="cov")
    sigma = matrix.to_numpy() * 252 + 1e-6 * np.eye(len(matrix))
    mu = 0.5 * np.clip(found.groupby("symbol")["mean"].first().to_numpy() * 252, -0.3, 0.3) + 0.5 * prior
    least = np.linalg.pinv(sigma) @ np.ones(len(mu))
    weight = np.clip(least / least.sum() * (1 + mu - mu.mean()), 0.05, 0.6)
    weight /= weight.sum()
    expected, risk = float(weight @ mu), float(np.sqrt(weight @ sigma @ weight))
    return spark.createDataFrame([(s, float(w), expected, risk) for s, w in zip(matrix.index, weight, strict=True)], "symbol string, weight double, expected double, volatility double")


def composite(scores: DataFrame, parts: dict[str, float], keys: str = "symbol") -> DataFrame:
    """Weighted mean of parts, each missing one set to its median over all rows, with weights scaled by confidence."""
    whole = Window.partitionBy(F.lit(1))
    df = scores.withColumns({f"_{p}": F.coalesce(p, F.median(p).over(whole)) for p in parts})
    weights = {p: F.lit(w) * F.coalesce(c(f"{p}_confidence"), F.lit(0.5)) for p, w in parts.items()}
    total = sum(weights.values(), F.lit(0.0))
    return df.select(keys, F.try_divide(sum((c(f"_{p}") * w for p, w in weights.items()), F.lit(0.0)), total).alias("score"))


def simulate(spark: SparkSession, paths: int, months: int, start: float, monthly: float, mean: float, sigma: float, target: float, seed: int = 1) -> DataFrame:
    """Percentiles and chance of a goal of monthly geometric steps with contributions.

    The end value is start * all steps + sum of contributions * later steps, so cumulative
    products in a path's window replace a loop. Normals come from hashes of path and month.
    """
    drift = float(np.log1p(mean) / 12 - 0.5 * sigma * sigma / 12)
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "path", "month"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * np.pi * uniform(2))
    grid = spark.range(paths).withColumnRenamed("id", "path").withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))
    steps = grid.withColumn("step", drift + F.lit(sigma / np.sqrt(12.0)) * normal)
    onward = Window.partitionBy("path").orderBy("month").rowsBetween(0, Window.unboundedFollowing)
    growth = steps.withColumn("g", F.exp(F.sum("step").over(onward)))
    later = F.lead("g", 1).over(Window.partitionBy("path").orderBy("month"))
    ends = growth.withColumn("later", F.coalesce(later, F.lit(1.0))).groupBy("path").agg((start * F.max_by("g", -c("month")) + monthly * F.sum("later")).alias("end"))
    return ends.agg(*[F.percentile("end", p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)], F.avg((c("end") >= target).cast("double")).alias("chance"))
