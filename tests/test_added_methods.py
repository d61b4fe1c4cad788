"""Detectors and forecast methods that a user adds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import anomaly, forecast


def above_ten(df, keys, ts, y):
    return df.withColumns({"above_ten_score": F.when(F.col(y) > 10, 1.0).otherwise(0.0), "above_ten_flag": F.col(y) > 10})


@pytest.fixture
def registries(monkeypatch):
    monkeypatch.setattr(anomaly, "DETECTORS", dict(anomaly.DETECTORS))
    monkeypatch.setattr(forecast, "METHODS", dict(forecast.METHODS))


def points(spark, values):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "series string, t long, y double")


def test_an_added_detector_votes(spark, registries):
    anomaly.add_detector("above_ten", above_ten)
    anomaly.add_detector("above_ten", above_ten)
    df = points(spark, [1.0, 2.0, 1.0, 2.0, 11.0, None, 1.0, 2.0])
    got = {r["t"]: (r["methods"], r["votes"], r["score"]) for r in anomaly.detect(df, ["series"], "t", "y", ["above_ten"]).collect()}
    assert got == {t: ("above_ten", 1, 1.0) if t == 4 else ("", 0, 0.0) for t in range(8)}
    got = {r["t"]: r["methods"].split(",") for r in anomaly.consensus(df, ["series"], "t", "y", detectors=["above_ten"]).collect()}
    assert "above_ten" in got[4] and not any("above_ten" in m for t, m in got.items() if t != 4)
    assert anomaly.detect(df.limit(0), ["series"], "t", "y", ["above_ten", "iqr"]).count() == 0


def test_names_and_columns_of_detectors_are_checked(spark, registries):
    with pytest.raises(ValueError):
        anomaly.add_detector("iqr", above_ten)
    with pytest.raises(ValueError):
        anomaly.add_detector("not a name", above_ten)
    anomaly.add_detector("empty", lambda df, keys, ts, y: df)
    with pytest.raises(ValueError):
        anomaly.detect(points(spark, [1.0]), ["series"], "t", "y", ["empty"])


def test_an_added_forecaster_takes_part(spark, registries):
    zero = lambda df, keys, ts, y, ahead: df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step"), F.lit(0.0).alias("forecast"))
    forecast.add_method("zero", zero)
    with pytest.raises(ValueError):
        forecast.add_method("naive", zero)
    rows = forecast.tournament(points(spark, [float(k % 3) for k in range(20)] + [0.0] * 4), ["series"], "t", "y", 4, ["naive", "zero"]).collect()
    assert {r["method"]: r["rank"] for r in rows} == {"zero": 1, "naive": 2} and {r["method"]: r["mae"] for r in rows} == {"zero": 0.0, "naive": 1.0}
