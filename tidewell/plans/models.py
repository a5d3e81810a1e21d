"""ML: models on bar features. Substitutes for learners Spark lacks are named in the README."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions import rolling as R
from tidewell.operators import indicators as I
from tidewell.operators import explain as X
from tidewell.operators import learning as L
from tidewell.operators import modelmatch as M
from tidewell.sources.views import candles

from . import oracle as O
from .technical import C

c = F.col
NAMES = list(I.FEATURES)


def _features(spark, d):
    return I.features(candles(spark, d)).select("symbol", "time", "close", "target", *NAMES).cache()


@query("ml01_boosted_direction")
def ml01(spark, d):
    return L.accuracy(L.classify(_features(spark, d), NAMES, "target", "boosting"), "target", "symbol")


@query("ml02_network_direction")
def ml02(spark, d):
    return L.accuracy(L.classify(_features(spark, d), NAMES, "target", "network"), "target", "symbol")


@query("ml03_model_comparison")
def ml03(spark, d):
    """Each learner, their vote and their stack: accuracy on the training and the test part, mean and deviation over folds, ranked."""
    return M.compared(I.features(candles(spark, d)).select("symbol", "time", "target", *NAMES).dropna(), NAMES, "target")


@query("ml04_grid_search")
def ml04(spark, d):
    return spark.createDataFrame(L.cross_validated(_features(spark, d), NAMES, "target"), "depth int, accuracy double")


def _means(spark, d):
    df = I.features(candles(spark, d)).withColumn("year", F.year("time"))
    return df.groupBy(F.concat_ws("-", "symbol", "year").alias("k")).agg(*[F.avg(n).alias(n) for n in NAMES])


@query("ml05_clusters")
def ml05(spark, d):
    found, quality = L.clusters(_means(spark, d), NAMES)
    return found.select("k", "cluster").withColumn("silhouette", F.lit(float(quality)))


_F2 = ("ret_20", "bb_width")


@query("ml06_outliers", f"""{C},{O.features('candles', 'f')}, m AS (SELECT symbol || '-' || year(time) AS k, {', '.join(f'avg({x}) AS {x}' for x in _F2)} FROM f GROUP BY 1),
z AS (SELECT k, {', '.join(f'({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0) AS {x}' for x in _F2)} FROM m)
SELECT a.k, NOT EXISTS (SELECT 1 FROM z b WHERE b.k <> a.k AND sqrt({' + '.join(f'pow(a.{x} - b.{x}, 2)' for x in _F2)}) <= 0.5::DOUBLE) AS outlier FROM z a""")
def ml06(spark, d):
    return L.outliers(_means(spark, d), list(_F2), "k", 0.5)


def _future(spark, d):
    df = I.features(candles(spark, d))
    return df.withColumn("future", F.try_divide(F.lead("close", 5).over(R.order()), c("close")) - 1)


@query("ml07_forecasts")
def ml07(spark, d):
    return L.forecast(_future(spark, d), NAMES, "future")


@query("ml08_selected_forecast")
def ml08(spark, d):
    """The model chosen over time folds, its last forecasts, and directions that pass the gate."""
    return L.selected_forecast(_future(spark, d), NAMES, "future", "target")


@query("ml08_time_folds", f"{C}, n AS (SELECT symbol, time, row_number() OVER ({O.W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles) SELECT symbol, time, greatest(-1, floor((i - (n - 4 * (n // 5))) / nullif(n // 5, 0)))::INT AS fold FROM n")
def ml08b(spark, d):
    return L.time_folds(candles(spark, d), 4).select("symbol", "time", "fold")


@query("ml09_universe_scores")
def ml09(spark, d):
    """One model over all symbols; each symbol's test accuracy and last prediction."""
    scored = L.classify(_features(spark, d), NAMES, "target", "forest")
    return scored.groupBy("symbol").agg(F.avg((c("prediction") == c("target")).cast("double")).alias("accuracy"), F.max_by("prediction", "time").alias("latest"))


@query("ml10_contributions")
def ml10(spark, d):
    last = I.last_bar(L.contributions(_future(spark, d).where("future is not null"), ["ret_5", "rsi", "bb_pos"], "future", ["symbol", "time"]).withColumn("t", c("time")), 3)
    return last.select("symbol", "time", "feature", F.round("value", 8).alias("value"), F.round("share", 6).alias("share"))


#: What a reader calls the features that are explained.
_LABELS = {"ret_5": "return of five bars", "rsi": "relative strength", "bb_pos": "place in the band", "bb_width": "width of the band"}


def _directed(spark, d):
    rows = I.features(candles(spark, d)).select("symbol", "time", "target", *_LABELS).dropna(subset=["target"])
    return L.ordered_split(rows).withColumn("label", (c("target") + 1).cast("double"))


@query("ml10_tree_contributions")
def ml10b(spark, d):
    """Shapley values of boosted trees that forecast the return of five bars, for all bars."""
    rows = _future(spark, d).dropna(subset=[*_LABELS, "future"])
    assembled = VectorAssembler(inputCols=list(_LABELS), outputCol="features").transform(rows)
    model = GBTRegressor(labelCol="future", maxIter=5, maxDepth=3, seed=1).fit(assembled)
    return X.tree_contributions(rows, model, list(_LABELS), ["symbol", "time"])


@query("ml10_explanations")
def ml10c(spark, d):
    """The signal of boosted trees for each bar of the test part, with reasons for and against it and a sentence."""
    rows = _directed(spark, d)
    classes = X.fitted_directions(rows.where("train"), list(_LABELS), "label")
    return X.explained(rows.where("not train"), classes, list(_LABELS), _LABELS, ["symbol", "time"])


@query("ml11_ordered_split", f"{C}, n AS (SELECT symbol, time, row_number() OVER ({O.W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles) SELECT symbol, time, i <= floor(n * 0.8::DOUBLE) AS train FROM n")
def ml11(spark, d):
    return L.ordered_split(candles(spark, d)).select("symbol", "time", "train")
