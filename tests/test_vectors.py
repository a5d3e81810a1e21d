"""Searches by blocks of products against column functions, over odd vectors, copies and near copies."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import vectors as V


def odd(spark):
    """Vectors of three components: copies, near copies, zeros, and some that are null, short, long or not finite."""
    rows = [(i, [float(i % 7), 1.0, float(i * i % 5)], i % 3) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0 + i * 1e-7], None) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    rows += [(340, None, 1), (350, [1.0, None, 2.0], 1), (360, [1.0, 2.0], 0), (370, [nan, 1.0, 1.0], 2), (380, [0.0, 0.0, 0.0], 0), (381, [inf, 0.0, 0.0], 0), (390, [1e80, 1.0, 1.0], 0), (391, [], 5)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def _set(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize(("k", "held", "most"), [(3, 500_000, 10_000), (1, 40, 10_000), (8, 40, 15)])
def test_search_equals_column_functions(spark, monkeypatch, k, held, most):
    monkeypatch.setattr(V, "MOST_HELD", held)
    points = odd(spark)
    queries = points.where("vec_id % 10 = 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "vec_id"))
    want = V.similarities(points, queries).withColumn("place", place).where(F.col("place") <= k)
    assert _set(V.search(points, queries, k, most_queries=most)) == _set(want)


def test_best_by_equals_column_functions(spark):
    points = odd(spark)
    queries = points.where("vec_id % 10 = 0")
    want = V.similarities(points, queries, keep=("label",)).groupBy("query", "label").agg(F.max("sim").alias("sim"))
    assert _set(V.best_by(points, queries, "label")) == _set(want)


def test_no_queries_give_no_rows(spark):
    points = odd(spark)
    assert V.search(points, points.where("vec_id < 0"), 3).count() == 0


def test_plain_vectors_meet_in_blocks_of_products(spark):
    """Pairs of plain vectors are no rows of a nested loop."""
    points = odd(spark)
    plan = V.search(points, points.where("vec_id % 10 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
