"""Contributions of features to what boosted trees and forests predict, as Shapley values.

A feature that is not known at a split sends a row down both branches, in the shares that the
training rows took. The value of a set of known features is the mean prediction then, and a
feature's contribution is its Shapley value in that game: contributions add up to the
prediction less the mean. Leaves are taken singly, so a leaf's work grows with the features on
its own path and not with all features. The table of leaves has trees x 2^depth rows whatever
the data; rows are explained where they lie, in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial, inf, prod

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value; steps are (feature, above, up to, share of rows) once a feature of its path."""

    value: float
    steps: tuple[tuple[int, float, float, float], ...]


def leaves(model: Model) -> list[Leaf]:
    """The leaves of a fitted ensemble of trees with continuous features: forest, boosted trees or one tree."""
    trees = getattr(model, "trees", None) or [model]
    boosted = type(model).__name__.startswith("GBT")
    weights = model.treeWeights if boosted else [1.0 / len(trees)] * len(trees)
    return [leaf for tree, weight in zip(trees, weights, strict=True) for leaf in _below(tree._call_java("rootNode"), weight, {})]


def _below(node, weight: float, path: dict[int, tuple[float, float, float]]) -> list[Leaf]:
    if node.getClass().getSimpleName() == "LeafNode":
        return [Leaf(weight * node.prediction(), tuple((f, *step) for f, step in sorted(path.items())))]
    feature, limit, rows = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
    above, up_to, share = path.get(feature, (-inf, inf, 1.0))
    found = []
    for child, bounds in ((node.leftChild(), (above, min(up_to, limit))), (node.rightChild(), (max(above, limit), up_to))):
        found += _below(child, weight, path | {feature: (*bounds, share * child.impurityStats().count() / rows)})
    return found


def mean_value(found: list[Leaf]) -> float:
    """What the ensemble predicts if no feature is known."""
    return sum(leaf.value * prod(share for *_, share in leaf.steps) for leaf in found)


def shapley(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Contributions of each feature (columns) to the prediction of each row of x."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.steps)
        known = [((x[:, f] > above) & (x[:, f] <= up_to)).astype(float) for f, above, up_to, _ in leaf.steps]
        shares = [share for *_, share in leaf.steps]
        for j in range(d):
            # sums[k]: over the sets of k other features, the share of the row that reaches the leaf
            sums = [np.ones(len(x))]
            for i in (i for i in range(d) if i != j):
                less, more = [s * shares[i] for s in sums], [s * known[i] for s in sums]
                sums = [a + b for a, b in zip([*less, 0.0], [0.0, *more], strict=True)]
            weighted = sum(factorial(k) * factorial(d - k - 1) / factorial(d) * s for k, s in enumerate(sums))
            out[:, leaf.steps[j][0]] += leaf.value * (known[j] - shares[j]) * weighted
    return out


def contributions(found: list[Leaf], features: list[str]) -> Column:
    """An array with each feature's contribution, in the order of features, which are doubles and not null."""

    @F.pandas_udf("array<double>")
    def explain(x: pd.Series) -> pd.Series:
        return pd.Series(list(shapley(found, np.stack(x.to_numpy())) if len(x) else []))

    return explain(F.array(*[c(f).cast("double") for f in features]))


def tree_contributions(df: DataFrame, model: Model, features: list[str], key: list[str]) -> DataFrame:
    """key, feature, value and share (of the absolute values of a row). Rows that lack a feature are left out."""
    names = F.array(*[F.lit(f) for f in features])
    arrays = df.dropna(subset=features).select(*key, contributions(leaves(model), features).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.abs(v))
    rows = arrays.select(*key, total.alias("_all"), F.posexplode("_v").alias("_i", "value"))
    return rows.select(*key, names[c("_i")].alias("feature"), "value", F.coalesce(F.try_divide(F.abs("value"), c("_all")), F.lit(0.0)).alias("share"))


def fitted_directions(df: DataFrame, features: list[str], label: str, trees: int = 5, depth: int = 3) -> list[list[Leaf]]:
    """The leaves of one class against the rest for the labels 0, 1, 2; df's labels are doubles."""
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    learner = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=1)
    return [leaves(m) for m in OneVsRest(classifier=learner, labelCol=label, parallelism=3).fit(assembled).models]


def explained(df: DataFrame, classes: list[list[Leaf]], features: list[str], labels: dict[str, str], key: list[str], top: int = 3) -> DataFrame:
    """key, signal, probability, base, reasons for and against it, and a sentence.

    classes are the leaves of the margins of the signals -1, 0, 1. The signal has the greatest
    margin (ties: the smaller), and its probability is its share of the three logistic margins.
    A reason has feature, value and percent (of the absolute contributions to that margin);
    at most `top` stand for and against, the largest first, ties by name. Features without a
    label go by their names. Rows that lack a feature are left out.
    """
    rows = df.dropna(subset=features).withColumns({f"_v{k}": contributions(found, features) for k, found in enumerate(classes)})
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    bases = [mean_value(found) for found in classes]
    rows = rows.withColumns({f"_m{k}": F.lit(b) + sum_of(c(f"_v{k}")) for k, b in enumerate(bases)})
    margins = [c(f"_m{k}") for k in range(len(classes))]
    best = F.array_position(F.array(*margins), F.greatest(*margins)).cast("int")
    chance = [1 / (1 + F.exp(-2 * m)) for m in margins]
    rows = rows.withColumns({"_k": best, "_p": F.element_at(F.array(*chance), best) / sum(chance[1:], chance[0])})
    rows = rows.withColumn("_v", F.element_at(F.array(*[c(f"_v{k}") for k in range(len(classes))]), c("_k")))
    total = F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.abs(v))
    rows = rows.withColumn("_all", total)
    reasons = F.zip_with(F.array(*[F.lit(f) for f in features]), "_v", lambda f, v: F.struct(F.abs(v).alias("size"), f.alias("feature"), v.alias("value"), F.coalesce(F.round(F.try_divide(F.abs(v) * 100, c("_all")), 1), F.lit(0.0)).alias("percent")))
    larger = lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    rows = rows.withColumn("_r", F.array_sort(reasons, larger))
    side = lambda keep: F.transform(F.slice(F.filter("_r", keep), 1, top), lambda r: F.struct(r["feature"].alias("feature"), r["value"].alias("value"), r["percent"].alias("percent")))
    rows = rows.withColumns({"reasons_for": side(lambda r: r["value"] > 0), "reasons_against": side(lambda r: r["value"] < 0)})
    named = F.create_map(*[F.lit(x) for f in features for x in (f, labels.get(f, f))])
    listed = lambda a: F.array_join(F.transform(a, lambda r: F.concat(named[r["feature"]], F.lit(" "), F.format_number(r["percent"], 1), F.lit(" %"))), ", ")
    words = F.element_at(F.array(*[F.lit(w) for w in ("SELL", "HOLD", "BUY")]), c("_k"))
    parts = [
        F.concat(words, F.lit(" with a probability of "), F.format_number(c("_p") * 100, 0), F.lit(" %.")),
        F.when(F.size("reasons_for") > 0, F.concat(F.lit("For it: "), listed("reasons_for"), F.lit("."))),
        F.when(F.size("reasons_against") > 0, F.concat(F.lit("Against it: "), listed("reasons_against"), F.lit("."))),
        F.when(c("_k") == 2, F.lit("Reasons to buy and to sell balance.")),
    ]
    base = F.element_at(F.array(*[F.lit(b) for b in bases]), c("_k"))
    return rows.select(*key, (c("_k") - 2).alias("signal"), c("_p").alias("probability"), base.alias("base"), "reasons_for", "reasons_against", F.concat_ws(" ", *parts).alias("sentence"))
