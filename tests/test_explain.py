"""Shapley values of trees against all subsets, explanations, and the comparison of classifiers."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tidewell.operators import explain as X
from tidewell.operators import modelmatch as M

NAMES = ["a", "b", "e", "g"]


def numbers(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 4)).round(3)
    y = 2 * x[:, 0] + (x[:, 1] > 0) * x[:, 2] + np.where(x[:, 3] > 1, 3.0, 0.0)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, e double, g double, y double")


def known_value(node, x, known):
    """The mean prediction of a tree for a row of which the features `known` are known."""
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    left, right = node.leftChild(), node.rightChild()
    if node.split().featureIndex() in known:
        return known_value(left if x[node.split().featureIndex()] <= node.split().threshold() else right, x, known)
    n, m = left.impurityStats().count(), right.impurityStats().count()
    return (n * known_value(left, x, known) + m * known_value(right, x, known)) / (n + m)


def by_subsets(model, weights, x):
    value = lambda known: sum(w * known_value(t._call_java("rootNode"), x, known) for t, w in zip(model.trees, weights))
    d, out = len(x), []
    for j in range(d):
        others = [i for i in range(d) if i != j]
        out.append(sum(factorial(k) * factorial(d - k - 1) / factorial(d) * (value({*s, j}) - value(set(s))) for k in range(d) for s in combinations(others, k)))
    return out


@pytest.mark.parametrize("boosted", [True, False])
def test_contributions_equal_those_of_all_subsets(spark, boosted):
    rows = numbers(spark)
    df = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    model = (GBTRegressor(labelCol="y", maxIter=3, maxDepth=4, seed=1) if boosted else RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1)).fit(df)
    weights = model.treeWeights if boosted else [1 / 3] * 3
    found = X.leaves(model)
    points = np.array([r[1:5] for r in rows.limit(6).collect()])
    np.testing.assert_allclose(X.shapley(found, points), [by_subsets(model, weights, p) for p in points], atol=1e-9)
    out = X.tree_contributions(rows, model, NAMES, ["id"]).groupBy("id").agg(F.sum("value").alias("v"), F.sum("share").alias("s"), F.count("*").alias("n"))
    off = model.transform(df).join(out, "id").where((F.abs(F.col("prediction") - F.col("v") - X.mean_value(found)) > 1e-9) | (F.abs(F.col("s") - 1) > 1e-9) | (F.col("n") != 4))
    assert out.count() == 400 and off.count() == 0


def test_one_tree_nulls_and_empty_tables(spark):
    rows = numbers(spark, 50)
    model = DecisionTreeRegressor(labelCol="y", maxDepth=2, seed=1).fit(VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows))
    holed = rows.withColumn("b", F.when(F.col("id") > 0, F.col("b")))
    assert X.tree_contributions(holed, model, NAMES, ["id"]).select("id").distinct().count() == 49
    assert X.tree_contributions(rows.limit(0), model, NAMES, ["id"]).count() == 0


def test_explained_signals(spark):
    step = lambda value, above: X.Leaf(value, ((0, 0.0 if above else -np.inf, np.inf if above else 0.0, 0.5),))
    classes = [[step(1.0, False), step(-1.0, True)], [X.Leaf(-0.5, ())], [step(-1.0, False), step(1.0, True)]]
    df = spark.createDataFrame([(1, 3.0, 0.0), (2, -3.0, 0.0), (3, None, 1.0)], "id int, a double, b double")
    up, down = X.explained(df, classes, ["a", "b"], {"a": "height"}, ["id"]).orderBy("id").collect()
    assert (up.signal, down.signal, up.base) == (1, -1, 0.0)
    assert [(r.feature, r.value, r.percent) for r in up.reasons_for] == [("a", 1.0, 100.0)] and up.reasons_against == []
    chances = [1 / (1 + np.exp(-2 * m)) for m in (-1.0, -0.5, 1.0)]
    assert up.probability == pytest.approx(chances[2] / sum(chances)) and down.probability == pytest.approx(up.probability)
    assert up.sentence == f"BUY with a probability of {100 * up.probability:.0f} %. For it: height 100.0 %."


def test_waves_come_near_a_radial_kernel(spark):
    df = VectorAssembler(inputCols=NAMES, outputCol="features").transform(numbers(spark, 20))
    rows = df.select("features", M.waves("features", 4, 4096).alias("w")).collect()
    x, w = np.array([r.features.toArray() for r in rows]), np.array([r.w.toArray() for r in rows])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 4)
    assert np.abs(w @ w.T - kernel).max() < 0.1


def test_comparison(spark):
    k = F.pmod(F.xxhash64("id"), F.lit(3))
    df = spark.range(240).select((F.col("id") % 2).cast("string").alias("symbol"), F.col("id").alias("time"), (k - 1).cast("int").alias("target"), (k + F.rand(1) * 0.1).alias("a"), F.rand(2).alias("b"))
    out = {r.model: r for r in M.compared(df, ["a", "b"], "target", 2).collect()}
    assert set(out) == {*M.contestants(1), "vote", "stack"} and sorted(r.place for r in out.values()) == [1, 2, 3, 4, 5, 6, 7]
    assert {r.n_test for r in out.values()} == {48}
    assert min(out["forest"].cv_mean, out["stack"].cv_mean, out["stack"].test_accuracy, out["radial_machine"].test_accuracy) > 0.9
    assert all(0 <= r.cv_std < 0.5 and 0 <= r.cv_mean <= 1 for r in out.values())


@pytest.mark.parametrize("classes", [(0,), (-1, 1)])
def test_comparison_of_learners_with_classes_that_do_not_occur(spark, classes):
    """Steady prices move by less than two percent, so a large table may have one class only; a machine then has no other side."""
    rows = [(s, i, classes[i // 2 % len(classes)]) for s in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, time int, target int").withColumns({"x": F.col("target") + F.randn(1) / 9, "y": F.randn(2)})
    found = M.compared(df, ["x", "y"], "target", folds=2).collect()
    assert len(found) == 7 and all(r.n_test == 16 for r in found)
    assert all(r.test_accuracy >= 0.9 for r in found if len(classes) == 1 or r.model in ("linear_machine", "boosting"))
