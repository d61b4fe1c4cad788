"""Values of models: linear fits against numpy, clusters and importances of data whose answer is known, forecasts of series that repeat."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from conftest import SF
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tarnwick.operators import forecast, ml


NAMES = ["l_quantity", "l_discount", "l_tax"]


def lines(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows = rows.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in NAMES], F.col("l_extendedprice").cast("double").alias("label"))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)


def test_linear_fits_equal_numpy(spark):
    """Least squares, and ridge with the penalty on scaled columns, as closed forms give them."""
    rows = lines(spark)
    data = rows.select(*NAMES, "label", "l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").toPandas()
    x, y = data[NAMES].to_numpy(), data["label"].to_numpy()
    z, t = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    for name, penalty in (("linear", 0.0), ("ridge", 1.0)):
        scaled = penalty / y.std(ddof=1)
        w = np.linalg.solve(z.T @ z / len(z) + scaled * np.eye(3), z.T @ t / len(z))
        want = y.mean() + y.std(ddof=1) * (z @ w)
        got = ml.regressor(name).fit(rows).transform(rows).orderBy("l_orderkey", "l_linenumber").select("prediction").toPandas()["prediction"].to_numpy()
        assert np.abs(got - want).max() < 1e-3 * y.std()


@pytest.mark.parametrize("name", ["kmeans", "bisecting"])
def test_clusters_of_far_groups(spark, name):
    rng = random.Random(3)
    centres = [(0, 0), (100, 0), (0, 100), (100, 100)]
    points = [(k, k % 4, centres[k % 4][0] + rng.gauss(0, 1), centres[k % 4][1] + rng.gauss(0, 1)) for k in range(400)]
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(points, "id long, real int, x double, y double"))
    pairs = ml.cluster(rows, name, 4).select("real", "cluster").distinct().collect()
    assert len(pairs) == len({r["real"] for r in pairs}) == len({r["cluster"] for r in pairs}) == 4


def test_importance_finds_the_column_that_tells(spark):
    rng = random.Random(4)
    data = [(k, rng.random(), rng.random(), rng.random()) for k in range(600)]
    rows = spark.createDataFrame([(k, a, b, c, float(b > 0.5), 3 * b + 0.5 * c) for k, a, b, c in data], "id long, a double, b double, c double, label double, y double")
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)
    got = ml.importance(ml.classifier("random_forest").fit(vectors), vectors).orderBy("rank").collect()
    assert got[0]["feature"] == "b" and got[0]["importance"] > 0.8 and sum(r["importance"] for r in got) == pytest.approx(1, abs=1e-5)
    # coefficients of a line: 3 and 0.5 of 3.5
    line = ml.regressor("linear", "y").fit(vectors)
    assert {r["feature"]: r["importance"] for r in ml.importance(line, vectors).collect()} == pytest.approx({"a": 0, "b": 3 / 3.5, "c": 0.5 / 3.5}, abs=1e-4)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), ml.regressor("linear", "y")]).fit(rows)
    drop = {r["feature"]: r["drop"] for r in ml.permutation_importance(model, rows, ["a", "b", "c"], "id", RegressionEvaluator(labelCol="y", metricName="r2")).collect()}
    assert drop["a"] == pytest.approx(0, abs=1e-6) and drop["b"] > 10 * drop["c"] > 0


def weeks(spark, n):
    """A weekly pattern that repeats exactly, in two series, one ten times the other."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(s, day + datetime.timedelta(days=k), f * (10.0 + (k % 7) ** 2)) for s, f in (("a", 1.0), ("b", 10.0)) for k in range(n)]
    return spark.createDataFrame(rows, "series string, day timestamp, y double")


def test_trees_follow_a_week(spark):
    """Six steps, beyond the first cut of lineage, each near the pattern's value."""
    got = {(r["series"], r["step"]): r["forecast"] for r in forecast.tree_forecast(weeks(spark, 84), ["series"], "day", "y", 6, "random_forest", 30).collect()}
    assert len(got) == 12
    for (s, step), value in got.items():
        want = (10.0 + ((83 + step) % 7) ** 2) * (1 if s == "a" else 10)
        assert value == pytest.approx(want, rel=0.15)


def test_requery_goes_on_with_the_best_method(spark):
    rows = weeks(spark, 70)
    best = forecast.tournament(rows, ["series"], "day", "y", 7, ["naive", "seasonal_naive", "moving_average"]).where("rank = 1").select("series", "method")
    assert {r["method"] for r in best.collect()} == {"seasonal_naive"}
    got = forecast.requery(rows, ["series"], "day", "y", 14, best).collect()
    first = datetime.datetime(2024, 1, 1)
    assert len(got) == 28
    for r in got:
        k = (r["day"] - first).days
        assert 70 <= k < 84 and r["method"] == "seasonal_naive" and r["forecast"] == (10.0 + (k % 7) ** 2) * (1 if r["series"] == "a" else 10)
