"""Comparison of classifiers by predictions out of fold, with a vote and a stack on top of them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import ordered_split, prepared
from .lineage import cut

c = F.col

CLASSES = 3


def waves(features: str, width: int, count: int = 64, scale: float | None = None, seed: int = 1) -> Column:
    """Random Fourier features of a vector column.

    Their inner products come near a radial kernel exp(-scale |x - y|^2), where scale is one over
    the number of features unless given, so a linear machine on them stands for a radial one.
    """
    rng = np.random.default_rng(seed)
    turns = rng.normal(0.0, np.sqrt(2 * (scale or 1 / width)), (width, count))
    shifts = rng.uniform(0, 2 * np.pi, count)

    @F.pandas_udf("array<double>")
    def turned(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / count) * np.cos(np.stack(x.to_numpy()) @ turns + shifts)) if len(x) else [])

    return array_to_vector(turned(vector_to_array(features)))


def contestants(width: int) -> dict:
    """The classifiers by name. Machines and boosting go one class against the rest."""
    machine = {"maxIter": 10, "regParam": 0.01, "labelCol": "label"}
    return {
        "linear_machine": OneVsRest(classifier=LinearSVC(**machine), parallelism=3),
        "radial_machine": OneVsRest(classifier=LinearSVC(featuresCol="waves", **machine), featuresCol="waves", parallelism=3),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=1),
        "boosting": OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=1), parallelism=3),
        "network": MultilayerPerceptronClassifier(layers=[width, 64, 32, CLASSES], maxIter=20, seed=1),
    }


def _fitted(learner, rows: DataFrame, present: list[float]):
    """The function that adds a fitted learner's prediction; present: the labels in the rows, in order.

    One class against the rest needs rows of both sides, so such a learner meets only the
    classes that are present; with a single one, that is the prediction.
    """
    if not isinstance(learner, OneVsRest) or len(present) == CLASSES:
        return learner.fit(rows).transform
    if len(present) == 1:
        return lambda df: df.withColumn("prediction", F.lit(present[0]))
    labels = F.array(*map(F.lit, present))
    model = learner.fit(rows.withColumn("label", (F.array_position(labels, c("label")) - 1).cast("double")))
    return lambda df: model.transform(df).withColumn("prediction", F.element_at(labels, (c("prediction") + 1).cast("int")))


def out_of_fold(df: DataFrame, features: list[str], target: str, folds: int, key: tuple[str, ...]) -> DataFrame:
    """key, label, part, fold, model and prediction of every row by each contestant.

    Part `fold` holds the ordered training rows as predicted by a learner that did not see their
    fold, `train` the same rows as predicted by one that saw them all, and `test` the rest. Folds
    go by a hash of the key. Target is -1, 0 or 1; labels are one more; not all need to occur. Rows have no nulls.
    """
    data = ordered_split(df).withColumn("label", (c(target) + 1).cast("double"))
    data = data.withColumn("fold", F.when(c("train"), F.pmod(F.xxhash64(*key), F.lit(folds))).otherwise(-1).cast("int"))
    scaling = Pipeline(stages=prepared(features)).fit(data.where("train"))
    data = cut(scaling.transform(data).select(*key, "label", "train", "fold", "features", waves("features", len(features)).alias("waves")))
    learnt = data.where("train")
    cells = learnt.select("fold", "label").distinct().collect()  # folds x classes at most
    present = lambda without=None: sorted({x.label for x in cells if x.fold != without})
    said = []
    for name, learner in contestants(len(features)).items():
        tell = lambda predicted, rows, part, name=name: predicted(rows).select(*key, "label", F.lit(part).alias("part"), "fold", F.lit(name).alias("model"), "prediction")
        said += [tell(_fitted(learner, learnt.where(c("fold") != k), present(k)), learnt.where(c("fold") == k), "fold", name) for k in range(folds)]
        whole = _fitted(learner, learnt, present())
        said += [tell(whole, learnt, "train", name), tell(whole, data.where("not train"), "test", name)]
    return cut(reduce(DataFrame.unionByName, said))


def stacked(said: DataFrame, folds: int, key: tuple[str, ...]) -> DataFrame:
    """Rows like those of out_of_fold, of a logistic learner on the contestants' predictions out of fold."""
    names = list(contestants(1))
    votes = said.groupBy(*key, "label", "part", "fold").pivot("model", names).agg(F.first("prediction"))
    flags = {f"_{n}_{k}": (c(n) == k).cast("double") for n in names for k in range(CLASSES)}
    rows = cut(VectorAssembler(inputCols=list(flags), outputCol="features").transform(votes.withColumns(flags)).select(*key, "label", "part", "fold", "features"))
    learner, seen = LogisticRegression(regParam=0.01), rows.where("part = 'fold'")
    tell = lambda model, df: model.transform(df).select(*key, "label", "part", "fold", F.lit("stack").alias("model"), "prediction")
    parts = [tell(learner.fit(seen.where(c("fold") != k)), seen.where(c("fold") == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, [*parts, tell(learner.fit(seen), rows.where("part <> 'fold'"))])


def voted(said: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows like those of out_of_fold, of the most frequent prediction; ties go to the smaller."""
    return said.groupBy(*key, "label", "part", "fold").agg(F.mode("prediction", True).alias("prediction")).withColumn("model", F.lit("vote"))


def compared(df: DataFrame, features: list[str], target: str, folds: int = 5, key: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """model, n_test, train_accuracy, test_accuracy, cv_mean, cv_std (over folds) and place by test accuracy, ties by name.

    The vote and the stack are judged like the contestants; the stack learns from predictions
    out of fold only, so what a contestant knows by heart does not count.
    """
    said = out_of_fold(df, features, target, folds, key)
    every = said.unionByName(voted(said, key)).unionByName(stacked(said, folds, key))
    cells = every.groupBy("model", "part", "fold").agg(F.count("*").alias("n"), F.count_if(c("prediction") == c("label")).alias("hits"))
    of = lambda part: F.sum(F.when(c("part") == part, c("hits"))) / F.sum(F.when(c("part") == part, c("n")))
    share = F.when(c("part") == "fold", c("hits") / c("n"))
    rows = cells.groupBy("model").agg(
        F.sum(F.when(c("part") == "test", c("n"))).alias("n_test"), of("train").alias("train_accuracy"), of("test").alias("test_accuracy"),
        F.avg(share).alias("cv_mean"), F.stddev_pop(share).alias("cv_std"),
    )
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("test_accuracy"), "model")))
