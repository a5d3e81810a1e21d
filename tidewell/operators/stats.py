"""Statistics of judged scores: areas, calibration, agreement, bootstraps, thresholds, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .groups import numbered


def counts_by_score(df: DataFrame, *keys: str, p: str = "p", y: str = "y", w: Column | None = None) -> DataFrame:
    """Weighted positives and negatives of each distinct score: what all rank statistics need, combined map-side."""
    w = F.lit(1.0) if w is None else w
    return df.groupBy(*keys, p).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0.0)).alias("neg"))


#: Cells of equal width between scores 0 and 1 in which running sums are taken; other scores fall into the outer ones.
CELLS = 4096


def below(counts: DataFrame, keys: list[str], p: str, x: str) -> DataFrame:
    """counts with _below: the sum of x over the smaller scores of the key.

    Sums within cells and over the cells before, so that no task orders more than a cell's
    distinct scores or the cells themselves.
    """
    cell = F.floor(F.least(F.greatest(F.col(p).cast("double"), F.lit(-1.0)), F.lit(2.0)) * CELLS)
    celled = counts.withColumn("_cell", cell)
    sums = celled.groupBy(*keys, "_cell").agg(F.sum(x).alias("_sum"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"))
    inside = F.coalesce(F.sum(x).over(Window.partitionBy(*keys, "_cell").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "_cell")]
    joined = celled.withColumn("_inside", inside).alias("l").join(sums.alias("r"), same)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in counts.columns], (F.col("_inside") + F.col("_before")).alias("_below"))


def auc(df: DataFrame, *keys: str, p: str = "p", y: str = "y", w: Column | None = None) -> DataFrame:
    """keys and auc: the chance that a positive scores above a negative, ties half; null for one class.

    Rows are counted by score first, so ordered windows run over distinct scores.
    """
    c = below(counts_by_score(df, *keys, p=p, y=y, w=w), list(keys), p, "neg")
    won = c.withColumn("_won", F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("_won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def calibration(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """bin, n, mean score and observed rate of equal-width bins, empty ones included."""
    found = df.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")


def kappa(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Cohen's agreement beyond chance of two labels, from the confusion counts; null if chance agreement is 1."""
    n = df.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*(keys or [F.lit(1)]))
    total = n.withColumn("all", F.sum("n").over(part))
    rows = total.groupBy(*keys, F.col(a).alias("v")).agg(F.sum("n").alias("na"), F.max("all").alias("all"))
    cols = total.groupBy(*keys, F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("na") / F.col("all") * F.col("nb") / F.col("all")).alias("pe"))
    same = total.groupBy(*keys).agg((F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.max("all")).alias("po"))
    both = same.join(chance, list(keys), "left") if keys else same.crossJoin(chance)
    return both.select(*keys, F.try_divide(F.col("po") - F.coalesce("pe", F.lit(0.0)), 1 - F.coalesce("pe", F.lit(0.0))).alias("kappa"))


def macro_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Mean F1 over the classes that occur as label or prediction; 0 where a class has no hit."""
    marks = F.array(F.struct(F.col(label).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("q"), (F.col(label) == F.col(predicted)).cast("int").alias("t")), F.struct(F.col(predicted).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("q"), F.lit(0).alias("t")))
    per = df.select(F.explode(marks).alias("m")).select("m.*").groupBy("k").agg(F.sum("l").alias("l"), F.sum("q").alias("q"), F.sum("t").alias("t"))
    return per.agg(F.avg(F.coalesce(F.try_divide(2 * F.col("t"), F.col("l") + F.col("q")), F.lit(0.0))).alias("macro_f1"))


def sweep(df: DataFrame, steps: int = 100, p: str = "p", y: str = "y") -> DataFrame:
    """threshold, n, hits, precision, recall and f1 for each of the grid's thresholds.

    Scores are counted in grid cells, and sums from the top give every threshold, so no
    row is compared with more than one.
    """
    cell = F.least(F.floor(F.round(F.col(p) * steps, 9)), F.lit(steps)).cast("long")
    found = df.groupBy(cell.alias("k")).agg(F.count("*").alias("n"), F.sum(F.col(y)).alias("t"))
    grid = df.sparkSession.range(steps + 1).withColumnRenamed("id", "k").join(found, "k", "left")
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("k"))
    total = F.sum(F.coalesce("t", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    rows = grid.select((F.col("k") / steps).alias("threshold"), F.sum(F.coalesce("n", F.lit(0))).over(down).alias("n"), F.sum(F.coalesce("t", F.lit(0))).over(down).alias("hits"), total.alias("all"))
    rows = rows.withColumns({"precision": F.try_divide("hits", "n"), "recall": F.try_divide("hits", "all")})
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("n") + F.col("all")), F.lit(0.0))).drop("all")


def best_f1(swept: DataFrame) -> DataFrame:
    """The threshold with the largest F1; the larger one on ties."""
    return swept.agg(F.max_by("threshold", F.struct(F.round("f1", 9), "threshold")).alias("threshold"))


def precise_enough(swept: DataFrame, precision: float, least: int = 0) -> DataFrame:
    """The smallest threshold of that precision and number of predictions; else the one with the best F1."""
    fit = (F.col("precision") >= precision) & (F.col("n") >= least)
    return swept.agg(F.coalesce(F.min(F.when(fit, F.col("threshold"))), F.max_by("threshold", F.struct(F.round("f1", 9), "threshold"))).alias("threshold"))


def draws(units: DataFrame, unit: str, reps: int, seed: int) -> DataFrame:
    """rep, unit, w: how often each of `reps` resamples with replacement draws each unit; every resample draws as many as there are.

    Units are numbered, and each draw of each repetition takes the number that its hash
    names, so totals are exact, counts combine before they are shuffled, and results repeat.
    """
    known = numbered(units.select(unit).distinct(), unit)
    n = known.count()
    drawn = units.sparkSession.range(reps * n).select((F.col("id") / max(n, 1)).cast("long").alias("rep"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))).alias("number"))
    return drawn.groupBy("rep", "number").agg(F.count("*").alias("w")).join(known, "number").select("rep", unit, "w")


def bootstrap_auc_difference(df: DataFrame, unit: str, a: str, b: str, reps: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval and standard error of auc(a) - auc(b) over resampled units (days, clusters)."""
    spark = df.sparkSession
    both = df.select(unit, "y", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.round(F.col(a), 6).alias("p")), F.struct(F.lit("b").alias("side"), F.round(F.col(b), 6).alias("p")))).alias("s")).select(unit, "y", "s.*")
    units = counts_by_score(both, unit, "side").join(draws(df, unit, reps, seed), unit)
    resampled = units.groupBy("rep", "side", "p").agg(F.sum(F.col("pos") * F.col("w")).alias("pos"), F.sum(F.col("neg") * F.col("w")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("rep", "side").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = resampled.withColumn("_won", F.col("pos") * (below + F.col("neg") / 2)).groupBy("rep").pivot("side", ["a", "b"]).agg(F.try_divide(F.sum("_won"), F.sum("pos") * F.sum("neg")))
    diff = per.select((F.col("a") - F.col("b")).alias("d"))
    tail = (1 - level) / 2
    return diff.agg(F.count("d").alias("reps"), F.avg("d").alias("mean"), F.percentile("d", tail).alias("low"), F.percentile("d", 1 - tail).alias("high"), F.stddev_samp("d").alias("se"))


def bootstrap_mean(df: DataFrame, cluster: str, inner: str | None, x: str, reps: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval and error of the mean of x when clusters, and within each drawn one its inner units, are resampled.

    Clusters and inner units are drawn exactly as often as there are, the inner ones anew
    each time their cluster is drawn.
    """
    rows = draws(df, cluster, reps, seed)
    if inner:
        sums = df.groupBy(cluster, inner).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))
        listed = sums.withColumn("_number", F.row_number().over(Window.partitionBy(cluster).orderBy(inner)) - 1)
        sizes = listed.groupBy(cluster).agg(F.count("*").alias("_k"))
        one = F.lit(1).cast("long")
        each = rows.join(sizes, cluster).withColumn("_time", F.explode(F.sequence(one, "w"))).withColumn("_draw", F.explode(F.sequence(one, "_k")))
        taken = each.withColumn("_number", F.pmod(F.xxhash64(F.lit(seed + 1), "rep", cluster, "_time", "_draw"), F.col("_k"))).groupBy("rep", cluster, "_number").agg(F.count("*").alias("w"))
        weighted = taken.join(listed, [cluster, "_number"])
    else:
        weighted = rows.join(df.groupBy(cluster).agg(F.sum(x).alias("_s"), F.count(x).alias("_n")), cluster)
    means = weighted.groupBy("rep").agg(F.try_divide(F.sum(F.col("_s") * F.col("w")), F.sum(F.col("_n") * F.col("w"))).alias("m"))
    return means.agg(F.count("m").alias("reps"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.stddev_samp("m").alias("se"))


def upper_bound(hits: Column, n: Column, level: float = 0.95) -> Column:
    """One-sided exact upper bound of a share: the p at which `hits` or fewer of n have chance 1 - level."""

    def solve(h: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for k, m in zip(h.tolist(), n.tolist(), strict=True):
            if not m or k >= m:
                out.append(1.0 if m else None)
                continue
            low, high = k / m, 1.0
            logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) for i in range(int(k) + 1)]
            for _ in range(60):
                p = (low + high) / 2
                cdf = sum(math.exp(a + i * math.log(p) + (m - i) * math.log1p(-p)) for i, a in enumerate(logs)) if 0 < p < 1 else float(p == 0)
                low, high = (p, high) if cdf > 1 - level else (low, p)
            out.append((low + high) / 2)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(solve, "double")(hits, n)


def verdict(low: Column, high: Column, margin: float) -> Column:
    """Superior if the interval lies above 0, equivalent if within the margin, inferior if below 0, else open."""
    return F.when(low > 0, "superior").when((low >= -margin) & (high <= margin), "equivalent").when(high < 0, "inferior").otherwise("open")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in edges (a, b), edges to itself included: the smallest node reachable."""
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return graph.components(edges).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def capped_assignment(sizes: list[tuple[str, int]], caps: dict[str, int], seed: int) -> dict[str, str]:
    """Clusters in seeded order to the first split with room; a driver-side plan over cluster sizes."""
    rng = np.random.default_rng(seed)
    left, out = dict(caps), {}
    for k in rng.permutation(len(sizes)):
        name, n = sizes[int(k)]
        out[name] = next((s for s, room in left.items() if room >= n), max(left, key=left.get))
        left[out[name]] -= n
    return out
