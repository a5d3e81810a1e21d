"""Models on features with Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prepared(features: list[str], scale: bool = True) -> list:
    assemble = VectorAssembler(inputCols=features, outputCol="raw" if scale else "features", handleInvalid="skip")
    return [assemble, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [assemble]


def logistic(df: DataFrame, features: list[str], label: str, penalty: float = 0.01) -> DataFrame:
    """df with probability of class 1."""
    model = Pipeline(stages=[*prepared(features), LogisticRegression(labelCol=label, regParam=penalty)]).fit(df)
    scored = model.transform(df)
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "prediction")


def ordered_split(df: DataFrame, share: float = 0.8, key: str = "symbol", time: str = "time") -> DataFrame:
    """df with train: whether a row is among its key's first share of rows."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("train", F.row_number().over(Window.partitionBy(key).orderBy(time)) <= F.floor(n * share))


def learners(n_features: int, classes: int = 3) -> dict:
    """The classifiers that are compared, by name. Boosting and linear models go one class against the rest."""
    return {
        "logistic": LogisticRegression(regParam=0.01),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=1),
        "boosting": OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=1)),
        "network": MultilayerPerceptronClassifier(layers=[n_features, 64, 32, classes], maxIter=30, seed=1),
    }


def classify(df: DataFrame, features: list[str], target: str, name: str) -> DataFrame:
    """Rows of the ordered test part with prediction, learnt on the ordered training part; target is -1, 0 or 1."""
    data = ordered_split(df).withColumn("label", (F.col(target) + 1).cast("double"))
    model = Pipeline(stages=[*prepared(features), learners(len(features))[name]]).fit(data.where("train"))
    return model.transform(data.where("not train")).withColumn("prediction", (F.col("prediction") - 1).cast("int"))


def accuracy(scored: DataFrame, target: str, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col(target)).cast("double")).alias("accuracy"))


def cross_validated(df: DataFrame, features: list[str], target: str, folds: int = 3, depths: tuple[int, ...] = (3, 5)) -> list[tuple[int, float]]:
    """Mean accuracy over folds of each depth of a forest."""
    data = df.withColumn("label", (F.col(target) + 1).cast("double"))
    forest = RandomForestClassifier(numTrees=10, seed=1)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).build()
    tuned = CrossValidator(estimator=Pipeline(stages=[*prepared(features), forest]), estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=1).fit(data)
    return [(d, float(a)) for d, a in zip(depths, tuned.avgMetrics, strict=True)]


def clusters(df: DataFrame, features: list[str], k: int = 3) -> tuple[DataFrame, float]:
    """df with cluster, and the silhouette."""
    model = Pipeline(stages=[*prepared(features), KMeans(k=k, seed=1)]).fit(df)
    scored = model.transform(df)
    quality = ClusteringEvaluator().evaluate(scored) if scored.select("prediction").distinct().limit(2).count() == 2 else 0.0
    return scored.withColumnRenamed("prediction", "cluster").drop("raw", "features"), quality


def outliers(df: DataFrame, features: list[str], key: str, eps: float) -> DataFrame:
    """key and outlier: no other row lies within eps in standardised features.

    Rows meet only in cells of width eps of the first two features and their neighbours;
    means and deviations are one aggregated row. A row without a feature counts as at its mean.
    """
    stats = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    scaled = df.crossJoin(F.broadcast(stats)).select(key, *[F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")), F.lit(0.0)).alias(f) for f in features])
    cells = [F.floor(F.col(f) / eps) for f in features[:2]]
    placed = scaled.withColumns({f"_c{i}": x for i, x in enumerate(cells)})
    near_ = scaled.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in features], *[x.alias(f"_b{i}") for i, x in enumerate(cells)])
    for i in range(len(cells)):
        near_ = near_.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_b{i}") + d for d in (-1, 0, 1)]))).drop(f"_b{i}")
    square = sum((F.pow(F.col(f) - F.col(f"_{f}"), 2) for f in features), F.lit(0.0))
    pairs = placed.join(near_, [f"_c{i}" for i in range(len(cells))]).where((F.col(key) != F.col("_k")) & (F.sqrt(square) <= eps))
    near = pairs.select(key).distinct().withColumn("outlier", F.lit(False))
    return scaled.select(key).join(near, key, "left").select(key, F.coalesce("outlier", F.lit(True)).alias("outlier"))


def forecast(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """model, rmse and mae of regressions on the ordered test part: plain, ridge, lasso and boosted trees."""
    data = ordered_split(df).withColumn("label", F.col(target).cast("double")).where("label is not null")
    models = {"linear": LinearRegression(), "ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0), "lasso": LinearRegression(regParam=0.001, elasticNetParam=1.0), "boosting": GBTRegressor(maxIter=5, maxDepth=3, seed=1)}
    rows = []
    for name, learner in models.items():
        scored = Pipeline(stages=[*prepared(features), learner]).fit(data.where("train")).transform(data.where("not train"))
        rows.append((name, *(float(RegressionEvaluator(metricName=m).evaluate(scored)) for m in ("rmse", "mae"))))
    return df.sparkSession.createDataFrame(rows, "model string, rmse double, mae double")


def time_folds(df: DataFrame, folds: int, key: str = "symbol", time: str = "time") -> DataFrame:
    """df with fold: 0 .. folds - 1 for the blocks of equal length at the end of each key's rows, -1 before them.

    Fold k is tested on block k and learnt on all rows before it.
    """
    i, n = F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1, F.count("*").over(Window.partitionBy(key))
    block = F.floor(n / (folds + 1))
    return df.withColumn("fold", F.greatest(F.floor(F.try_divide(i - (n - folds * block), block)), F.lit(-1)).cast("int"))


def selected_forecast(df: DataFrame, features: list[str], target: str, label: str, folds: int = 4) -> DataFrame:
    """symbol, model, r2 and the forecast of each symbol's last row, with its direction, gate and confidence.

    df has the features, target (the return of the next bars, null at the end) and label (-1, 0, 1).
    The model with the best mean r2 over time folds is learnt again on all rows. The
    forecast is clipped to a fifth, then annualised and clipped to -90 % .. 300 %. A direction
    counts if its classifier beats the most frequent class by two points on the last fifth of
    the symbol's rows, else it is 0. Confidence is half from r2 and half from that accuracy.
    """
    data = time_folds(df.where(F.col(target).isNotNull()).withColumn("label", F.col(target).cast("double")), folds).cache()
    models = {"ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "boosting": GBTRegressor(maxIter=10, maxDepth=3, stepSize=0.1, seed=1)}
    score = RegressionEvaluator(metricName="r2")
    fitted = lambda name, rows: Pipeline(stages=[*prepared(features), models[name]]).fit(rows)
    means = {name: sum(score.evaluate(fitted(name, data.where(F.col("fold") < k)).transform(data.where(F.col("fold") == k))) for k in range(folds)) / folds for name in models}
    best = max(means, key=means.get)
    last = df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).where("_n = 1")
    forecast_ = fitted(best, data).transform(last).select("symbol", F.col("prediction").alias("forecast"))

    tested = classify(data.drop("label").withColumnRenamed("fold", "_fold"), features, label, "boosting")
    share = Window.partitionBy("symbol")
    common = tested.groupBy("symbol", label).count().select("symbol", F.max("count").over(share).alias("_most"), F.sum("count").over(share).alias("_all")).distinct()
    judged = accuracy(tested, label, "symbol").join(common, "symbol").select("symbol", "accuracy", (F.col("_most") / F.col("_all")).alias("baseline"))
    direction = tested.groupBy("symbol").agg(F.max_by("prediction", "time").alias("signal"))
    r2 = float(means[best])
    joined = forecast_.join(judged, "symbol").join(direction, "symbol")
    return joined.select("symbol", F.lit(best).alias("model"), F.lit(r2).alias("r2"), "forecast", annualised(F.col("forecast")).alias("year_percent"), "accuracy", "baseline", *gated(F.col("signal"), F.col("accuracy"), F.col("baseline"), r2))


def annualised(forecast_: Column, bars: int = 5) -> Column:
    """A forecast for some bars as percent a year: clipped to a fifth before, and to -90 .. 300 after."""
    year = (F.pow(1 + F.least(F.greatest(forecast_, F.lit(-0.2)), F.lit(0.2)), F.lit(252 / bars)) - 1) * 100
    return F.round(F.least(F.greatest(year, F.lit(-90.0)), F.lit(300.0)), 2)


def gated(signal: Column, accuracy_: Column, baseline: Column, r2: float) -> list[Column]:
    """reliable, signal (0 unless reliable) and confidence."""
    reliable = accuracy_ >= baseline + 0.02
    fit = max(0.0, min(1.0, (r2 + 1) / 2))
    return [reliable.alias("reliable"), F.when(reliable, signal).otherwise(0).alias("signal"), F.round(0.5 * fit + 0.5 * accuracy_, 4).alias("confidence")]


def contributions(df: DataFrame, features: list[str], target: str, key: list[str]) -> DataFrame:
    """Each row's linear contribution of each feature: coefficient times the distance from the mean, and its share."""
    data = df.withColumn("label", F.col(target).cast("double"))
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    model = LinearRegression(regParam=0.01).fit(assembler.transform(data))
    means = data.agg(*[F.avg(f).alias(f"_{f}") for f in features])
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f) - F.col(f"_{f}"))).alias("value")) for f, w in zip(features, model.coefficients, strict=True)])
    rows = data.crossJoin(F.broadcast(means)).select(*key, F.explode(parts).alias("p")).select(*key, "p.*")
    total = F.sum(F.abs("value")).over(Window.partitionBy(*key))
    return rows.withColumn("share", F.coalesce(F.try_divide(F.abs("value"), total), F.lit(0.0)))
