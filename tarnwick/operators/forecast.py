"""Forecasts for many series in parallel: naive family, smoothing, ARIMA, features with trees, direct models; intervals and a tournament.

A series is a group, never the data set. Where a solver runs in Python, one task holds one series.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut
from . import timeseries as ts_ops


def _steps(df: DataFrame, ahead: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))


def naive(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int) -> DataFrame:
    """``(keys, step, forecast)``: the last value."""
    return _steps(df.groupBy(*keys).agg(F.max_by(y, ts).alias("forecast")), ahead).select(*keys, "step", "forecast")


def seasonal_naive(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, period: int = 7) -> DataFrame:
    """The last cycle of the lesser of ``period`` and the rows, again and again."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    tail = df.withColumn("back", back).where(F.col("back") <= period).select(*keys, "back", F.col(y).alias("forecast"))
    size = tail.groupBy(*keys).agg(F.max("back").alias("p"))
    at = _steps(size, ahead).withColumn("back", F.col("p") - F.pmod(F.col("step") - 1, F.col("p")))
    return at.join(tail, [*keys, "back"]).select(*keys, "step", "forecast")


def moving_average(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, window: int = 7) -> DataFrame:
    """The mean of the last ``window`` values."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    mean = df.withColumn("back", back).where(F.col("back") <= window).groupBy(*keys).agg(F.avg(y).alias("forecast"))
    return _steps(mean, ahead).select(*keys, "step", "forecast")


def _smoothed(y: np.ndarray, ahead: int, period: int) -> np.ndarray:
    """Additive level, trend from 4 values on and, with ``period`` and two cycles, season; the parameters of a grid with the least squared error."""
    n = len(y)
    seasonal = period > 1 and n >= 2 * period
    grid = [0.05, 0.2, 0.4, 0.6, 0.8]
    a, b, g = (x.ravel() for x in np.meshgrid(grid, [0.01, 0.05, 0.2] if n >= 4 else [0.0], [0.05, 0.2, 0.5] if seasonal else [0.0], indexing="ij"))
    if seasonal:
        level, trend = np.full(len(a), y[:period].mean()), np.full(len(a), (y[period : 2 * period].mean() - y[:period].mean()) / period)
        season = np.tile(y[:period] - y[:period].mean(), (len(a), 1))
    else:
        level, trend, season = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0] if n >= 4 else 0.0), np.zeros((len(a), 1))
    p = season.shape[1]
    error = np.zeros(len(a))
    for t in range(1, n):
        s = season[:, t % p].copy()
        guess = level + trend + s
        error += (y[t] - guess) ** 2
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend if n >= 4 else trend
        season[:, t % p] = g * (y[t] - new) + (1 - g) * s if seasonal else s
        level = new
    k = int(error.argmin())
    h = np.arange(1, ahead + 1)
    return level[k] + trend[k] * h + season[k, (n - 1 + h) % p]


def _arima(y: np.ndarray, ahead: int, period: int) -> np.ndarray:
    """ARIMA(1,1,1), with ``period`` and two cycles also an autoregression at that lag; conditional sum of squares on a refined grid. Under 8 values: the last one."""
    if len(y) < 8:
        return np.full(ahead, y[-1])
    d = np.diff(y)
    seasonal = period > 1 and len(y) >= 2 * period and len(d) > period + 2
    centre = np.zeros(3)
    width = 0.9
    best = None
    for _ in range(4):
        axis = np.linspace(-1, 1, 7)
        phi, theta, rho = (np.clip(c + width * x.ravel(), -0.98, 0.98) for c, x in zip(centre, np.meshgrid(axis, axis, axis if seasonal else [0.0], indexing="ij")))
        e, total = np.zeros(len(phi)), np.zeros(len(phi))
        for t in range(1, len(d)):
            far = d[t - period] if seasonal and t >= period else 0.0
            e = d[t] - (phi * d[t - 1] + rho * far + theta * e)
            total += e * e
        k = int(total.argmin())
        centre, width, best = np.array([phi[k], theta[k], rho[k]]), width / 3, e[k]
    phi, theta, rho = centre
    hist, out, e = list(d), [], best
    for _ in range(ahead):
        nxt = phi * hist[-1] + (rho * hist[-period] if seasonal else 0.0) + theta * e
        e = 0.0
        hist.append(nxt)
        out.append(nxt)
    return y[-1] + np.cumsum(out)


SOLVERS = {
    "exp_smoothing": lambda y, h, p: _smoothed(y, h, 1),
    "holt_winters": _smoothed,
    "arima": lambda y, h, p: _arima(y, h, 1),
    "sarima": _arima,
}


def solved(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, method: str, period: int = 7) -> DataFrame:
    """``(keys, step, forecast)`` by a solver of :data:`SOLVERS`, one series a group. NULL values are left out; a series without values has no forecast."""
    solver = SOLVERS[method]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("t_", kind="stable")["y_"].to_numpy(float)
        out = pd.DataFrame({"step": np.arange(1, ahead + 1, dtype=np.int32), "forecast": solver(values, ahead, period)})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "step", "forecast"]]

    rows = df.where(F.col(y).isNotNull()).select(*keys, F.col(ts).alias("t_"), F.col(y).cast("double").alias("y_"))
    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, step int, forecast double")


_SHORT = {"lags": (1, 2, 3, 7), "windows": (7,)}


def _ml_features(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return ts_ops.rolling(ts_ops.lags(ts_ops.calendar(df, ts), keys, ts, ["y"], _SHORT["lags"]), keys, ts, "y", _SHORT["windows"])


_ML_COLUMNS = ["y_lag_1", "y_lag_2", "y_lag_3", "y_lag_7", "roll_mean_7", "roll_std_7", "roll_min_7", "roll_max_7", "month", "day", "dayofweek", "dayofyear", "is_weekend"]


def tree_forecast(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, model: str = "gbt", trees: int | None = None, seed: int = 42) -> DataFrame:
    """``(keys, step, forecast)``: one model over all series; each step's features come from what is known or forecast before it. Only the last rows of a series go through the steps."""
    at = "time_"
    rows = df.where(F.col(y).isNotNull()).select(*keys, F.col(ts).cast("timestamp").alias(at), F.col(y).cast("double").alias("y"))
    train = _ml_features(rows, keys, at).where("y_lag_7 is not null")
    regressor = RandomForestRegressor(labelCol="y", numTrees=trees or 100, maxDepth=8, seed=seed) if model == "random_forest" else GBTRegressor(labelCol="y", maxIter=trees or 100, maxDepth=4, stepSize=0.05, seed=seed, maxBins=255 if model == "hist_gbt" else 32)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=_ML_COLUMNS, outputCol="features", handleInvalid="keep"), regressor]).fit(train)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))
    tail = rows.withColumn("b_", back).where("b_ <= 8").drop("b_").withColumn("step", F.lit(0))
    future = ts_ops.future_timestamps(rows, keys, at, ahead)
    for k in range(1, ahead + 1):
        new = future.where(F.col("step") == k).select(*keys, at, F.lit(None).cast("double").alias("y"), "step")
        now = _ml_features(tail.unionByName(new), keys, at).where(F.col("step") == k)
        tail = tail.unionByName(fitted.transform(now).select(*keys, at, F.col("prediction").alias("y"), "step"))
        if k % 5 == 0:
            tail = cut(tail)
    return tail.where("step > 0").select(*keys, "step", F.col("y").alias("forecast"))


def direct_forecast(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, past: int = 14) -> DataFrame:
    """``(keys, step, forecast)``: a ridge regression for each step on the last ``past`` values, over all series."""
    windows = ts_ops.sequences(df.where(F.col(y).isNotNull()), keys, ts, y, past, ahead).withColumn("features", array_to_vector(F.transform("x", lambda v: v.cast("double"))))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    last = df.where(F.col(y).isNotNull()).withColumn("b_", back).where(F.col("b_") <= past).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(y).cast("double").alias("v")))).alias("x")).where(F.size("x") == past)
    last = last.withColumn("features", array_to_vector(F.transform("x", lambda v: v["v"])))
    parts = []
    for k in range(1, ahead + 1):
        model = LinearRegression(labelCol="label", regParam=0.01, solver="normal").fit(windows.select("features", F.col("target")[k - 1].cast("double").alias("label")))
        parts.append(model.transform(last).select(*keys, F.lit(k).alias("step"), F.col("prediction").alias("forecast")))
    return reduce(DataFrame.union, parts)


def intervals(forecasts: DataFrame, residuals: DataFrame, keys: list[str]) -> DataFrame:
    """``forecasts(keys, step, forecast)`` with ``sigma`` and 80 % and 95 % bounds: the population deviation of ``residuals(keys, residual)``, or, under 1e-6, 5 % of the mean of |forecast| plus 1; it grows with the root of the step."""
    sd = residuals.groupBy(*keys).agg(F.stddev_pop("residual").alias("s"))
    size = forecasts.groupBy(*keys).agg((F.avg(F.abs("forecast")) * 0.05 + 1).alias("alone"))
    rows = forecasts.join(sd, keys, "left").join(size, keys).withColumn("sigma", F.when(F.col("s") >= 1e-6, F.col("s")).otherwise(F.col("alone")))
    wide = F.col("sigma") * F.sqrt("step")
    bound = lambda z: F.round(F.col("forecast") + z * wide, 2)
    return rows.select(*keys, "step", F.round("forecast", 2).alias("forecast"), F.round("sigma", 3).alias("sigma"), bound(-1.282).alias("low_80"), bound(1.282).alias("high_80"), bound(-1.96).alias("low_95"), bound(1.96).alias("high_95"))


def metrics(pairs: DataFrame, keys: list[str], train: DataFrame | None = None, series: list[str] | None = None, ts: str = "ts", y: str = "y") -> DataFrame:
    """``(keys, mae, rmse, mape, smape, r2, residual_mean, residual_std[, mase])`` of ``(keys, actual, forecast)``.

    Percent errors leave out actual zeros; R2 is -5 at least, 0 where the actual values don't vary. With the
    ``train`` rows of the ``series`` keys ``mase`` is the error over the mean step of the training values.
    """
    e, a, f = F.col("actual") - F.col("forecast"), F.col("actual"), F.col("forecast")
    r = lambda c, name: F.round(c, 4).alias(name)
    total = F.var_pop(a) * F.count(a)
    out = pairs.where("actual is not null and forecast is not null").groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), r(F.sqrt(F.avg(e * e)), "rmse"), r(F.avg(F.when(a != 0, F.abs(e / a))) * 100, "mape"),
        r(F.avg(F.when(F.abs(a) + F.abs(f) > 0, 2 * F.abs(e) / (F.abs(a) + F.abs(f))).otherwise(0.0)) * 100, "smape"),
        r(F.when(total > 1e-8, F.greatest(F.lit(-5.0), 1 - F.sum(e * e) / total)).otherwise(0.0), "r2"), r(F.avg(e), "residual_mean"), r(F.stddev_pop(e), "residual_std"),
    )
    if train is not None:
        step = train.withColumn("d_", F.abs(F.col(y) - F.lag(y).over(ts_ops.ordered(series, ts)))).groupBy(*series).agg(F.avg("d_").alias("scale"))
        out = out.join(step, series, "left").withColumn("mase", F.round(F.when(F.col("scale") > 1e-8, F.col("mae") / F.col("scale")), 4)).drop("scale")
    return out.withColumn("mae", F.round("mae", 4))


METHODS = {
    "naive": naive,
    "seasonal_naive": seasonal_naive,
    "moving_average": moving_average,
} | {name: (lambda df, keys, ts, y, ahead, name=name: solved(df, keys, ts, y, ahead, name)) for name in SOLVERS}


def add_method(name: str, method) -> None:
    """Makes ``method``, ``(df, keys, ts, y, ahead)`` -> ``(keys, step from 1, forecast)``, known as ``name`` to tournaments and requeries. The same one may be added again; a name that another has is refused."""
    if not name.isidentifier() or METHODS.get(name, method) is not method:
        raise ValueError(f"{name!r} is no new name of a method")
    METHODS[name] = method


def _split(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int) -> tuple[DataFrame, DataFrame]:
    split = ts_ops.holdout(df, keys, ts, ahead)
    truth = split.where("part = 'validation'").withColumn("step", F.row_number().over(ts_ops.ordered(keys, ts))).select(*keys, "step", F.col(ts), F.col(y).alias("actual"))
    return split.where("part = 'train'").drop("part"), truth


def tournament(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, methods: list[str]) -> DataFrame:
    """``(keys, method, mae, rmse, mase, rank)`` on the last ``ahead`` rows of each series, ranked by MAE, then name; the best has rank 1."""
    train, truth = _split(df, keys, ts, y, ahead)
    parts = [METHODS[m](train, keys, ts, y, ahead).withColumn("method", F.lit(m)) for m in methods]
    scored = metrics(reduce(DataFrame.unionByName, parts).join(truth, [*keys, "step"]), [*keys, "method"], train, keys, ts, y)
    return scored.select(*keys, "method", "mae", "rmse", "mase", F.row_number().over(Window.partitionBy(*keys).orderBy("mae", "method")).alias("rank"))


def comparison(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, method: str) -> DataFrame:
    """``(keys, step, ts, actual, forecast)`` on the held-out rows."""
    train, truth = _split(df, keys, ts, y, ahead)
    return truth.join(METHODS[method](train, keys, ts, y, ahead), [*keys, "step"]).select(*keys, "step", ts, "actual", "forecast")


def history(df: DataFrame, keys: list[str], ts: str, y: str, rows: int = 30) -> DataFrame:
    """The last ``rows`` points of each series."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    return df.withColumn("b_", back).where(F.col("b_") <= rows).select(*keys, ts, y)


def requery(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int, best: DataFrame) -> DataFrame:
    """``(keys, ts, forecast, method)`` for another horizon by each series' method in ``best(keys, method)``; times go on from the last observation."""
    names = [r["method"] for r in best.select("method").distinct().orderBy("method").collect()]
    parts = [METHODS[m](df.join(best.where(F.col("method") == m).select(*keys), keys, "left_semi"), keys, ts, y, ahead).withColumn("method", F.lit(m)) for m in names]
    return reduce(DataFrame.unionByName, parts).join(ts_ops.future_timestamps(df, keys, ts, ahead), [*keys, "step"]).select(*keys, ts, "forecast", "method")
