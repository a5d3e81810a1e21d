"""Models: learners on features, explanations and clusters."""

from pyspark.sql import functions as F

from tidewell.operators import learning as L


def separable(spark, n=300):
    k = F.col("id") % 3
    return spark.range(n).select((F.col("id") % 2).cast("string").alias("symbol"), F.col("id").alias("time"), (k - 1).cast("int").alias("target"), (k + F.rand(1) * 0.1).alias("a"), F.rand(2).alias("b"))


def test_forest_learns(spark):
    scored = L.classify(separable(spark), ["a", "b"], "target", "forest")
    assert L.accuracy(scored, "target").first().accuracy > 0.9


def test_split_is_ordered(spark):
    out = L.ordered_split(separable(spark, 100)).groupBy("symbol").agg(F.count_if("train").alias("n"), F.max(F.when(F.col("train"), F.col("time"))).alias("a"), F.min(F.when(~F.col("train"), F.col("time"))).alias("b")).collect()
    assert all(r.n == 40 and r.a < r.b for r in out)


def test_logistic_is_a_probability(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(3)).alias("x"))
    p = L.logistic(df, ["x"], "y").groupBy("y").agg(F.avg("probability").alias("p")).collect()
    by = {r.y: r.p for r in p}
    assert 0 < by[0] < 0.3 and 0.7 < by[1] < 1


def test_contributions_add_up(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.rand(5).alias("z")).withColumn("y", 2 * F.col("x"))
    out = L.contributions(df, ["x", "z"], "y", ["id"]).groupBy("id").agg(F.sum("share").alias("s"))
    assert out.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_outliers(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.1), ("c", 9.0)], "k string, x double")
    assert {r.k for r in L.outliers(df, ["x"], "k", 0.5).where("outlier").collect()} == {"c"}


def test_clusters(spark):
    df = spark.createDataFrame([(str(i), float(i % 2 * 10 + i * 0.01)) for i in range(20)], "k string, x double")
    found, quality = L.clusters(df, ["x"], 2)
    assert quality > 0.9 and found.select("cluster").distinct().count() == 2


def test_folds_are_ordered_blocks_of_equal_length(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", i) for i in range(3)], "symbol string, time int")
    out = [(r.symbol, r.fold) for r in L.time_folds(df, 4).orderBy("symbol", "time").collect()]
    assert [f for s, f in out if s == "a"] == [-1] * 7 + [k for k in range(4) for _ in range(4)]


def test_forecast_rules(spark):
    df = spark.createDataFrame([(0.0, 1, 0.6, 0.5), (0.01, 1, 0.51, 0.5), (9.0, -1, 0.52, 0.5), (-9.0, -1, 0.9, 0.5)], "f double, s int, a double, b double")
    out = df.select(L.annualised(F.col("f")).alias("y"), *L.gated(F.col("s"), F.col("a"), F.col("b"), 0.5)).collect()
    assert [r.y for r in out] == [0.0, round((1.01 ** 50.4 - 1) * 100, 2), 300.0, -90.0]
    assert [(r.reliable, r.signal) for r in out] == [(True, 1), (False, 0), (True, -1), (True, -1)]
    assert [r.confidence for r in out] == [0.675, 0.63, 0.635, 0.825]
