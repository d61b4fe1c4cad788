"""Windows over stretches of a series equal windows over the whole series, whatever share of the rows one has."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import Window, functions as F

from tarnwick.functions.halo import Halo, numbered
from tarnwick.operators import anomaly
from tarnwick.streaming import anomalies


@pytest.fixture(scope="module")
def points(spark):
    """One series with 90 % of the rows, one of two rows, one without a name; gaps and spikes."""
    rng = random.Random(9)
    names = ["hot"] * 1800 + ["cold"] * 120 + ["two"] * 2 + [None] * 78
    rows = [(n, i, None if rng.random() < 0.1 else rng.gauss(50, 3) + (60 if rng.random() < 0.01 else 0)) for i, n in enumerate(rng.sample(names, len(names)))]
    # the first values of a series are missing, and no three are near each other for a while
    rows = [(n, i, None if n == "cold" and i < 900 and i % 3 else v) for n, i, v in rows]
    return spark.createDataFrame(rows, "series string, at long, y double").repartition(5)


def same(got, want):
    key = lambda r: tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*got.columns).collect()))


def test_numbers_go_up_within_a_series(points):
    rank = F.row_number().over(Window.partitionBy("series").orderBy("at")) - 1
    same(numbered(points, ["series"], ["at"], "n"), points.withColumn("n", rank.cast("long")))


@pytest.mark.parametrize("stretch", [1, 25, 10**6])
def test_windows_reach_over_the_ends_of_stretches(points, stretch):
    halo = Halo(points, ["series"], ["at"], 13, 6, stretch)
    w = Window.partitionBy("series").orderBy("at")
    same(halo.own(halo.rows.withColumns({"s": F.sum("y").over(halo.window(-13, 6)), "n": F.count("y").over(halo.window(-13, -2))}), "s", "n"),
         points.withColumns({"s": F.sum("y").over(w.rowsBetween(-13, 6)), "n": F.count("y").over(w.rowsBetween(-13, -2))}))
    most = halo.rows.groupBy("series", "stretch_").count().agg(F.max("count")).first()[0]
    assert most <= max(stretch, 13) + 13 + 6


@pytest.mark.parametrize("stretch", [1, 40])
def test_values_carried_from_stretch_to_stretch(points, stretch):
    halo = Halo(points.withColumn("z", F.col("y") + 1), ["series"], ["at"], 3, 0, stretch)
    after = Window.partitionBy("series").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    got = halo.own(halo.next_known(halo.rows, ["y", "z"]))
    same(got, points.withColumns({"y": F.first("y", True).over(after), "z": F.first("y", True).over(after) + 1}))


@pytest.mark.parametrize("detect", [anomaly.rolling_zscore, anomaly.residuals, anomaly.change_points])
def test_detectors_by_stretches(points, detect):
    same(detect(points, ["series"], "at", "y", stretch=20), detect(points, ["series"], "at", "y", stretch=10**9))


def test_rolling_scores_by_plain_windows(points):
    w = Window.partitionBy("series").orderBy("at")
    rows = points.withColumns({"n": F.count("y").over(w.rowsBetween(-13, 0)), "m": F.avg("y").over(w.rowsBetween(-13, 0)), "s": F.stddev_samp("y").over(w.rowsBetween(-13, 0))})
    after = w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({c: F.first(F.when(F.col("n") >= 3, F.col(c)), True).over(after) for c in ("m", "s")})
    z = F.coalesce(F.abs(F.col("y") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1e-6), F.lit(0.0))
    same(anomaly.rolling_zscore(points, ["series"], "at", "y", stretch=30).drop("rolling_score"), points.join(rows.select("at", (z > 2.8).alias("rolling_flag")), "at"))


def test_stream_rule_by_stretches(points):
    rows = points.select(F.coalesce("series", F.lit("none")).alias("series"), F.lit("y").alias("column"), F.timestamp_seconds("at").alias("ts"), F.col("at").alias("event_id"), F.col("y").alias("value")).where("value is not null")
    same(anomalies.batch_anomalies(rows, stretch=50), anomalies.batch_anomalies(rows, stretch=10**9))


def test_no_rows(spark, points):
    none = points.limit(0)
    assert anomaly.rolling_zscore(none, ["series"], "at", "y").collect() == anomaly.residuals(none, ["series"], "at", "y").collect() == []


def test_no_plan_reads_a_series_to_its_end(spark, points):
    plan = anomaly.rolling_zscore(points, ["series"], "at", "y")._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower().replace(" ", "")


def test_gaps_of_a_long_series(spark):
    from tarnwick.operators import cleaning

    n = 200_000
    df = spark.range(n).select(F.lit("s").alias("k"), F.col("id").alias("i"), F.when(F.col("id").isin(5, n - 100), F.col("id").cast("double")).alias("v"))
    began = time.perf_counter()
    got = cleaning.fill_order_gaps(df, "v", ["k"], ["i"]).groupBy("v").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()
    assert sorted(map(tuple, got)) == [(5.0, 0, 5), (float(n - 100), 6, n - 1)]
    assert time.perf_counter() - began < 60  # windows that start anew at each row take minutes
    nulls = spark.createDataFrame([(None, 1, None), (None, 2, 4.0), (None, 3, None), ("e", 1, None)], "k string, i int, v double")
    assert sorted(map(tuple, cleaning.fill_order_gaps(nulls, "v", ["k"], ["i"]).collect()), key=str) == [("e", 1, 0.0), (None, 1, 4.0), (None, 2, 4.0), (None, 3, 4.0)]
