"""Queries: time series, forecasts and anomalies over daily series of orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import anomaly, forecast, timeseries as ts
from .base import DAILY, EVENT_DAYS, Section, derived, table

S = Section()
query = S.query
K, T, Y = ["series"], "day", "y"
_D = f"d AS ({DAILY})"
_E = f"d AS ({EVENT_DAYS})"
_W = "PARTITION BY series ORDER BY day"


def daily(spark, d) -> DataFrame:
    return derived(spark, d, DAILY)


def event_days(spark, d) -> DataFrame:
    return derived(spark, d, EVENT_DAYS)


@query("time_column_candidates", """SELECT 'o_orderdate' AS "column", CAST(1.0 AS DOUBLE) AS score UNION ALL SELECT 'updated_at', round(0.4 + 0.5 * count(TRY_CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS TIMESTAMP)) / count(o_orderdate), 4) FROM orders""")
def _(spark, d):
    return ts.time_column_candidates(derived(spark, d, "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate, CAST(CAST(o_orderdate AS DATE) AS STRING) AS updated_at FROM orders"))


@query("temporal_profile", f"""WITH {_E}, l AS (SELECT *, date_diff('day', lag(day) OVER ({_W}), day) * 86400.0 AS g FROM d),
p AS (SELECT series, count(*) AS n, min(day) AS start, max(day) AS "end", count(*) - count(DISTINCT day) AS duplicates, quantile_cont(g, 0.5) AS m, stddev_samp(g) AS s FROM l GROUP BY 1)
SELECT series, n, start, "end", duplicates, round(m, 3) AS median_seconds, CASE WHEN m BETWEEN 50 AND 70 THEN '1min' WHEN m BETWEEN 3300 AND 3900 THEN '1H' WHEN m BETWEEN 82800 AND 90000 THEN '1D' WHEN m BETWEEN 590000 AND 620000 THEN '1W' ELSE 'IRREGULAR' END AS frequency,
 coalesce(s < 0.1 * m, false) AS regular, CAST(greatest(0, floor(date_diff('day', start, "end") * 86400.0 / m) - n + 1) AS BIGINT) AS missing_intervals FROM p""")
def _(spark, d):
    return ts.temporal_profile(event_days(spark, d), K, T)


@query("series_autocorr", f"WITH {_D}, l AS (SELECT series, y, lag(y, 1) OVER ({_W}) AS l1, lag(y, 7) OVER ({_W}) AS l7 FROM d) SELECT series, CAST(1 AS INTEGER) AS lag, round(corr(y, l1), 4) AS r FROM l GROUP BY series UNION ALL SELECT series, 7, round(corr(y, l7), 4) FROM l GROUP BY series")
def _(spark, d):
    return ts.autocorrelations(daily(spark, d), K, T, Y, [1, 7])


@query("series_trend", f"WITH {_D}, r AS (SELECT *, row_number() OVER ({_W}) AS i FROM d), b AS (SELECT series, regr_slope(y, i) AS s, avg(abs(y)) AS a FROM r GROUP BY 1) SELECT series, round(s, 6) AS slope, CASE WHEN s / (a + 1e-9) > 0.002 THEN 'UPWARD' WHEN s / (a + 1e-9) < -0.002 THEN 'DOWNWARD' ELSE 'STATIONARY' END AS trend FROM b")
def _(spark, d):
    return ts.trend(daily(spark, d), K, T, Y)


_ACF = ", ".join(f"lag(y, {k}) OVER ({_W}) AS l{k}" for k in range(2, 31))
_ACF_ROWS = " UNION ALL ".join(f"SELECT series, {k} AS lag, round(corr(y, l{k}), 4) AS r, count(*) AS n FROM l GROUP BY series" for k in range(2, 31))


@query("series_seasonality", f"""WITH {_E}, l AS (SELECT series, y, {_ACF} FROM d), a AS ({_ACF_ROWS}), g AS (SELECT * FROM a WHERE lag <= n // 2 AND r > 0.35 AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY series ORDER BY r DESC, lag) = 1)
SELECT s.series, CAST(g.lag AS INTEGER) AS period, coalesce(g.r, 0.0) AS strength FROM (SELECT DISTINCT series FROM d) s LEFT JOIN g USING (series)""")
def _(spark, d):
    return ts.seasonality(event_days(spark, d), K, T, Y)


@query("ts_calendar", f"WITH {_D} SELECT series, day AS date, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS dayofweek, CAST(dayofyear(day) AS INTEGER) AS dayofyear, CAST(quarter(day) AS INTEGER) AS quarter, CAST(dayofweek(day) IN (0, 6) AS INTEGER) AS is_weekend FROM d")
def _(spark, d):
    rows = daily(spark, d).withColumnRenamed("day", "date")
    return ts.calendar(rows, "date").select("series", "date", "year", "month", "day", "dayofweek", "dayofyear", "quarter", "is_weekend")


@query("ts_lags", f"WITH {_D} SELECT series, day, y, " + ", ".join(f"lag(y, {k}) OVER ({_W}) AS y_lag_{k}" for k in ts.LAGS) + " FROM d")
def _(spark, d):
    return ts.lags(daily(spark, d), K, T, [Y]).drop("n")


def _roll(n: int) -> str:
    w = f"OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(avg(y) {w}, 6) AS roll_mean_{n}, round(coalesce(stddev_samp(y) {w}, 0), 3) AS roll_std_{n}, min(y) {w} AS roll_min_{n}, max(y) {w} AS roll_max_{n}"


@query("ts_rolling", f"WITH {_E} SELECT series, day, {', '.join(map(_roll, ts.WINDOWS))} FROM d")
def _(spark, d):
    rows = ts.rolling(event_days(spark, d), K, T, Y)
    return rows.select("series", "day", *[F.round(c, 6 if "mean" in c else 3).alias(c) if "mean" in c or "std" in c else c for c in rows.columns if c.startswith("roll_")])


@query("ts_expanding", f"WITH {_E} SELECT series, day, round(avg(y) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS expanding_mean FROM d")
def _(spark, d):
    return ts.expanding(event_days(spark, d), K, T, Y).select("series", "day", F.round("expanding_mean", 6).alias("expanding_mean"))


@query("ts_diff", f"WITH {_D}, l AS (SELECT series, day, lag(y, 1) OVER ({_W}) AS a, lag(y, 2) OVER ({_W}) AS b FROM d) SELECT series, day, round(coalesce(a - b, 0), 2) AS diff_1, round(coalesce(CASE WHEN b <> 0 THEN (a - b) / b END, 0), 6) AS pct_1 FROM l")
def _(spark, d):
    return ts.differences(daily(spark, d), K, T, Y).select("series", "day", F.round("diff_1", 2).alias("diff_1"), F.round("pct_1", 6).alias("pct_1"))


@query("ts_covariate_lag", f"WITH {_D} SELECT series, day, lag(n, 1) OVER ({_W}) AS n_lag_1 FROM d")
def _(spark, d):
    return ts.lags(daily(spark, d), K, T, ["n"], (1,)).select("series", "day", "n_lag_1")


@query("ts_sequences", f"WITH {_E}, r AS (SELECT series, day, list(y) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x, list(y) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS t FROM d) SELECT series, day, round(list_sum(x), 2) AS x_sum, x[1] AS x_first, x[7] AS x_last, t[1] AS t_first, t[3] AS t_last FROM r WHERE len(x) = 7 AND len(t) = 3")
def _(spark, d):
    rows = ts.sequences(event_days(spark, d), K, T, Y, 7, 3)
    return rows.select("series", "day", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 2).alias("x_sum"), F.col("x")[0].alias("x_first"), F.col("x")[6].alias("x_last"), F.col("target")[0].alias("t_first"), F.col("target")[2].alias("t_last"))


@query("ts_standardize", f"""WITH {_D}, r AS (SELECT *, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY series) AS c FROM d), s AS (SELECT series, avg(y) AS m, stddev_pop(y) AS sd FROM r WHERE i <= floor(c * 0.8) GROUP BY 1)
SELECT series, day, round((y - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS y_scaled FROM d JOIN s USING (series)""")
def _(spark, d):
    return ts.standardize(daily(spark, d), K, T, Y).select("series", "day", F.round("y_scaled", 6).alias("y_scaled"))


@query("ts_holdout_split", f"WITH {_D} SELECT series, day, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY day DESC) <= 7 THEN 'validation' ELSE 'train' END AS part FROM d")
def _(spark, d):
    return ts.holdout(daily(spark, d), K, T, 7).select("series", "day", "part")


@query("future_timestamps", f"""WITH {_E}, t AS (SELECT series, max(day) AS a, max(day) FILTER (r = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r FROM d) WHERE r <= 2 GROUP BY 1)
SELECT series, CAST(i AS INTEGER) AS step, CAST(a + CAST(date_diff('day', b, a) * i AS INTEGER) AS DATE) AS day FROM (SELECT *, unnest(range(1, 8)) AS i FROM t)""")
def _(spark, d):
    return ts.future_timestamps(event_days(spark, d), K, T, 7).withColumn("day", F.col("day").cast("date"))


_STEPS = "SELECT series, CAST(i AS INTEGER) AS step, {v} AS forecast FROM (SELECT *, unnest(range(1, 8)) AS i FROM {t})"


@query("forecast_naive", f"WITH {_D}, b AS (SELECT series, arg_max(y, day) AS v FROM d GROUP BY 1) " + _STEPS.format(v="v", t="b"))
def _(spark, d):
    return forecast.naive(daily(spark, d), K, T, Y, 7)


_BACK = "r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS back FROM d)"


@query("forecast_seasonal_naive", f"WITH {_D}, {_BACK} SELECT series, CAST(8 - back AS INTEGER) AS step, y AS forecast FROM r WHERE back <= 7")
def _(spark, d):
    return forecast.seasonal_naive(daily(spark, d), K, T, Y, 7)


@query("forecast_moving_average", f"WITH {_D}, {_BACK}, b AS (SELECT series, round(avg(y), 4) AS v FROM r WHERE back <= 7 GROUP BY 1) " + _STEPS.format(v="v", t="b"))
def _(spark, d):
    return forecast.moving_average(daily(spark, d), K, T, Y, 7).withColumn("forecast", F.round("forecast", 4))


for _name, _method in (("forecast_exp_smoothing", "exp_smoothing"), ("forecast_holt_winters", "holt_winters"), ("forecast_arima", "arima"), ("forecast_sarima", "sarima")):
    S.queries[_name] = lambda spark, d, m=_method: forecast.solved(event_days(spark, d), K, T, Y, 7, m)


@query("forecast_ml")
def _(spark, d):
    return forecast.tree_forecast(event_days(spark, d), K, T, Y, 3, "gbt", 20)


@query("forecast_direct")
def _(spark, d):
    return forecast.direct_forecast(daily(spark, d), K, T, Y, 3)


_FIT = f"{_D}, s AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS back FROM d), train AS (SELECT * FROM s WHERE back > 7), truth AS (SELECT series, day, y AS actual, CAST(8 - back AS INTEGER) AS step FROM s WHERE back <= 7), tb AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS b FROM train)"
_NAIVE = "naive AS (SELECT series, arg_max(y, day) AS f FROM train GROUP BY 1)"
_METRICS = """round(avg(abs(actual - f)), 4) AS mae, round(sqrt(avg((actual - f) ** 2)), 4) AS rmse, round(avg(CASE WHEN actual <> 0 THEN abs((actual - f) / actual) END) * 100, 4) AS mape,
 round(avg(CASE WHEN abs(actual) + abs(f) > 0 THEN 2 * abs(actual - f) / (abs(actual) + abs(f)) ELSE 0 END) * 100, 4) AS smape, round(CASE WHEN var_pop(actual) * count(*) > 1e-8 THEN greatest(-5.0, 1 - sum((actual - f) ** 2) / (var_pop(actual) * count(*))) ELSE 0 END, 4) AS r2, round(avg(actual - f), 4) AS residual_mean, round(stddev_pop(actual - f), 4) AS residual_std"""


@query("forecast_comparison", f"WITH {_FIT}, {_NAIVE} SELECT series, step, day, actual, f AS forecast FROM truth JOIN naive USING (series)")
def _(spark, d):
    return forecast.comparison(daily(spark, d), K, T, Y, 7, "naive")


@query("forecast_metrics", f"WITH {_FIT}, {_NAIVE} SELECT series, {_METRICS} FROM truth JOIN naive USING (series) GROUP BY 1")
def _(spark, d):
    return forecast.metrics(forecast.comparison(daily(spark, d), K, T, Y, 7, "naive"), K)


@query("forecast_intervals", f"""WITH {_FIT}, {_NAIVE}, sd AS (SELECT series, stddev_pop(actual - f) AS s FROM truth JOIN naive USING (series) GROUP BY 1), b AS (SELECT series, arg_max(y, day) AS v FROM d GROUP BY 1)
SELECT series, CAST(i AS INTEGER) AS step, round(v, 2) AS forecast, round(g, 3) AS sigma, round(v - 1.282 * g * sqrt(i), 2) AS low_80, round(v + 1.282 * g * sqrt(i), 2) AS high_80, round(v - 1.96 * g * sqrt(i), 2) AS low_95, round(v + 1.96 * g * sqrt(i), 2) AS high_95
FROM (SELECT b.series, v, CASE WHEN s >= 1e-6 THEN s ELSE 0.05 * abs(v) + 1 END AS g, unnest(range(1, 8)) AS i FROM b JOIN sd USING (series))""")
def _(spark, d):
    rows = daily(spark, d)
    held = forecast.comparison(rows, K, T, Y, 7, "naive").select("series", (F.col("actual") - F.col("forecast")).alias("residual"))
    return forecast.intervals(forecast.naive(rows, K, T, Y, 7), held, K)


@query("forecast_tournament", f"""WITH {_FIT}, {_NAIVE}, p AS (SELECT series, step, actual, f, 'naive' AS method FROM truth JOIN naive USING (series)
 UNION ALL SELECT t.series, step, actual, x.y, 'seasonal_naive' FROM truth t JOIN tb x ON x.series = t.series AND x.b = 8 - t.step
 UNION ALL SELECT t.series, step, actual, m.f, 'moving_average' FROM truth t JOIN (SELECT series, avg(y) AS f FROM tb WHERE b <= 7 GROUP BY 1) m USING (series)),
sc AS (SELECT series, avg(abs(g)) AS scale FROM (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY day) AS g FROM train) GROUP BY 1),
m AS (SELECT series, method, avg(abs(actual - f)) AS e, round(sqrt(avg((actual - f) ** 2)), 4) AS rmse FROM p GROUP BY 1, 2)
SELECT series, method, round(e, 4) AS mae, rmse, round(e / scale, 4) AS mase, CAST(row_number() OVER (PARTITION BY series ORDER BY round(e, 4), method) AS INTEGER) AS rank FROM m JOIN sc USING (series)""")
def _(spark, d):
    return forecast.tournament(daily(spark, d), K, T, Y, 7, ["naive", "seasonal_naive", "moving_average"])


def drift_line(df: DataFrame, keys: list[str], ts: str, y: str, ahead: int) -> DataFrame:
    """A method that a user might add: the line through the first and the last point, carried on."""
    ends = df.groupBy(*keys).agg(F.min_by(y, ts).alias("a"), F.max_by(y, ts).alias("b"), F.count("*").alias("n"))
    step = F.explode(F.sequence(F.lit(1), F.lit(ahead)))
    return ends.select("*", step.alias("step")).select(*keys, "step", (F.col("b") + F.col("step") * (F.col("b") - F.col("a")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("forecast"))


@query("forecast_tournament_added", f"""WITH {_FIT}, {_NAIVE}, ends AS (SELECT series, arg_min(y, day) AS a, arg_max(y, day) AS b, count(*) AS n FROM train GROUP BY 1),
p AS (SELECT series, step, actual, f, 'naive' AS method FROM truth JOIN naive USING (series) UNION ALL SELECT series, step, actual, b + step * (b - a) / greatest(n - 1, 1), 'drift_line' FROM truth JOIN ends USING (series)),
sc AS (SELECT series, avg(abs(g)) AS scale FROM (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY day) AS g FROM train) GROUP BY 1),
m AS (SELECT series, method, avg(abs(actual - f)) AS e, round(sqrt(avg((actual - f) ** 2)), 4) AS rmse FROM p GROUP BY 1, 2)
SELECT series, method, round(e, 4) AS mae, rmse, round(e / scale, 4) AS mase, CAST(row_number() OVER (PARTITION BY series ORDER BY round(e, 4), method) AS INTEGER) AS rank FROM m JOIN sc USING (series)""")
def _(spark, d):
    forecast.add_method("drift_line", drift_line)
    return forecast.tournament(daily(spark, d), K, T, Y, 7, ["naive", "drift_line"])


@query("forecast_history", f"WITH {_D}, {_BACK} SELECT series, day, y FROM r WHERE back <= 30")
def _(spark, d):
    return forecast.history(daily(spark, d), K, T, Y)


@query("forecast_requery")
def _(spark, d):
    rows = event_days(spark, d)
    best = forecast.tournament(rows, K, T, Y, 5, ["naive", "seasonal_naive", "moving_average", "holt_winters"]).where("rank = 1").select("series", "method")
    return forecast.requery(rows, K, T, Y, 14, best).withColumn("day", F.col("day").cast("date"))


# anomalies: single events by type

_EV = "SELECT event_type AS series, event_id, ts, value AS y FROM events"
_V = f"v AS ({_EV})"


def events(spark, d) -> DataFrame:
    return derived(spark, d, _EV)


_CLIP = "round(least(1.0, greatest(0.0, {0})), 4)"


@query("anomaly_zscore", f"WITH {_V}, s AS (SELECT series, avg(y) AS m, stddev_samp(y) AS sd FROM v GROUP BY 1), z AS (SELECT event_id, coalesce(CASE WHEN sd > 0 THEN (y - m) / sd END, 0) AS z FROM v JOIN s USING (series)) SELECT event_id, round(z, 4) AS z, {_CLIP.format('abs(z) / 6.0')} AS zscore_score, abs(z) > 3 AS zscore_flag FROM z")
def _(spark, d):
    return anomaly.zscore(events(spark, d), K, Y).select("event_id", "z", "zscore_score", "zscore_flag")


@query("anomaly_mad", f"WITH {_V}, s AS (SELECT series, quantile_cont(y, 0.5) AS m FROM v GROUP BY 1), t AS (SELECT series, quantile_cont(abs(y - m), 0.5) AS dv FROM v JOIN s USING (series) GROUP BY 1), z AS (SELECT event_id, coalesce(CASE WHEN dv > 0 THEN 0.6745 * (y - m) / dv END, 0) AS z FROM v JOIN s USING (series) JOIN t USING (series)) SELECT event_id, round(z, 4) AS mad_z, {_CLIP.format('abs(z) / 7.0')} AS mad_score, abs(z) > 3.5 AS mad_flag FROM z")
def _(spark, d):
    return anomaly.modified_zscore(events(spark, d), K, Y).select("event_id", "mad_z", "mad_score", "mad_flag")


@query("anomaly_iqr", f"WITH {_V}, s AS (SELECT series, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM v GROUP BY 1), z AS (SELECT event_id, greatest(a - 1.5 * (b - a) - y, y - (b + 1.5 * (b - a)), 0) AS f, b - a AS w FROM v JOIN s USING (series)) SELECT event_id, {_CLIP.format('f / (w + 1e-6)')} AS iqr_score, f > 0 AS iqr_flag FROM z")
def _(spark, d):
    return anomaly.iqr(events(spark, d), K, Y).select("event_id", "iqr_score", "iqr_flag")


@query("anomaly_rolling_z", f"""WITH {_V}, r AS (SELECT *, count(y) OVER w AS c, avg(y) OVER w AS m, stddev_samp(y) OVER w AS sd FROM v WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
f AS (SELECT event_id, y, first_value(CASE WHEN c >= 3 THEN m END IGNORE NULLS) OVER x AS m, first_value(CASE WHEN c >= 3 THEN sd END IGNORE NULLS) OVER x AS sd FROM r WINDOW x AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
z AS (SELECT event_id, coalesce(abs(y - m) / CASE WHEN sd > 0 THEN sd ELSE 1e-6 END, 0) AS z FROM f) SELECT event_id, {_CLIP.format('z / 5.6')} AS rolling_score, z > 2.8 AS rolling_flag FROM z""")
def _(spark, d):
    return anomaly.rolling_zscore(events(spark, d), K, "ts", Y).select("event_id", "rolling_score", "rolling_flag")


_RESID = f"""r AS (SELECT *, CASE WHEN count(y) OVER w >= 3 THEN quantile_cont(y, 0.5) OVER w ELSE y END AS expected FROM v WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING)),
q AS (SELECT *, y - expected AS residual FROM r), u AS (SELECT *, CASE WHEN count(residual) OVER t >= 3 THEN stddev_samp(residual) OVER t END AS rsd FROM q WINDOW t AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
res AS (SELECT *, coalesce(abs(residual) / CASE WHEN rsd > 1e-6 THEN rsd END, 0) AS rz FROM u)"""


@query("anomaly_residual", f"WITH {_V}, {_RESID} SELECT event_id, round(expected, 4) AS expected, round(residual, 4) AS residual, {_CLIP.format('rz / 6.0')} AS residual_score, rz > 3 AS residual_flag FROM res")
def _(spark, d):
    return anomaly.residuals(events(spark, d), K, "ts", Y).select("event_id", "expected", "residual", "residual_score", "residual_flag")


_CHANGE = f"""w AS (SELECT series, day, count(y) OVER b AS nb, count(y) OVER a AS na, avg(y) OVER b AS mb, avg(y) OVER a AS ma, var_samp(y) OVER b AS vb, var_samp(y) OVER a AS va FROM d WINDOW b AS ({_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), a AS ({_W} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
t AS (SELECT *, CASE WHEN nb = 7 AND na = 7 THEN abs(ma - mb) / sqrt(vb / 7 + va / 7 + 1e-8) END AS t FROM w), c AS (SELECT *, max(t) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM t)"""


@query("change_points", f"WITH {_D}, {_CHANGE} SELECT series, day, round(t, 4) AS t, round(abs(ma - mb), 4) AS magnitude, round(100 * (ma - mb) / (abs(mb) + 1e-6), 2) AS pct_change, CASE WHEN ma > mb THEN 'UP' ELSE 'DOWN' END AS direction, round(least(1.0, t / 5), 4) AS confidence FROM c WHERE t >= 2.5 AND t = top")
def _(spark, d):
    return anomaly.change_points(daily(spark, d), K, T, Y)


@query("anomaly_isolation_forest")
def _(spark, d):
    rows = anomaly.isolation_forest(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"])
    return rows.select("p_partkey", "isolation_score", "isolation_flag")


@query("anomaly_lof", """WITH s AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS sa, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS sb FROM part),
x AS (SELECT p_partkey AS i, (p_size - a) / sa AS u, (p_retailprice - b) / sb AS w FROM part, s),
n AS (SELECT p.i, q.i AS j, round(sqrt((p.u - q.u) * (p.u - q.u) + (p.w - q.w) * (p.w - q.w)), 9) AS dist FROM x p JOIN x q ON p.i <> q.i QUALIFY row_number() OVER (PARTITION BY p.i ORDER BY dist, q.i) <= 15),
k AS (SELECT i, max(dist) AS kd FROM n GROUP BY 1), l AS (SELECT n.i, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.i = n.j GROUP BY 1),
o AS (SELECT n.i, avg(l.lrd) AS o FROM n JOIN l ON l.i = n.j GROUP BY 1), f AS (SELECT l.i, o / lrd AS lof FROM o JOIN l USING (i)), t AS (SELECT quantile_cont(lof, 0.95) AS p, max(greatest(0, lof - 1)) AS b FROM f)
SELECT i AS p_partkey, round(lof, 4) AS lof, round(least(1.0, greatest(0.0, (lof - 1) / b)), 4) AS lof_score, lof > p AS lof_flag FROM f, t""")
def _(spark, d):
    return anomaly.local_outlier_factor(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("anomaly_reconstruction")
def _(spark, d):
    rows = anomaly.reconstruction(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", "reconstruction_score", "reconstruction_flag")


_LIMITS = "SELECT event_id, CASE event_type WHEN 'click' THEN 'room_temperature' WHEN 'view' THEN 'voltage' WHEN 'error' THEN 'vibration' ELSE event_type END AS metric, value AS y FROM events"


@query("anomaly_limits", f"""WITH l AS ({_LIMITS}) SELECT event_id, CAST(CASE WHEN metric = 'room_temperature' THEN CASE WHEN y > 95 THEN 1.0 WHEN y < 50 OR y > 80 THEN 0.6 ELSE 0 END WHEN metric = 'voltage' THEN CASE WHEN y < 190 THEN 1.0 WHEN y < 210 OR y > 245 THEN 0.6 ELSE 0 END
 WHEN metric = 'vibration' THEN CASE WHEN y > 0.12 THEN 1.0 WHEN y < 0 OR y > 0.08 THEN 0.6 ELSE 0 END ELSE 0 END AS DOUBLE) AS limit_score,
 CASE metric WHEN 'room_temperature' THEN y > 95 WHEN 'voltage' THEN y < 190 WHEN 'vibration' THEN y > 0.12 ELSE false END AS breach FROM l""")
def _(spark, d):
    return anomaly.limits(derived(spark, d, _LIMITS), "metric", Y).select("event_id", "limit_score", "breach")


def _severity(score: str, z: str, breach: str = "false") -> str:
    return f"CASE WHEN {breach} OR {score} >= 0.85 OR abs({z}) >= 4 THEN 'CRITICAL' WHEN {score} >= 0.65 OR abs({z}) >= 3 THEN 'HIGH' WHEN {score} >= 0.45 OR abs({z}) >= 2 THEN 'MEDIUM' ELSE 'LOW' END"


@query("anomaly_severity", f"SELECT event_id, {_severity('value / 100', '(value - 20) / 10')} AS severity FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", anomaly.severity(F.col("value") / 100, (F.col("value") - 20) / 10, F.lit(False)).alias("severity"))


_CONSENSUS = f"""WITH {_V}, {_RESID}, st AS (SELECT series, avg(y) AS am, stddev_samp(y) AS asd, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.25) AS qa, quantile_cont(y, 0.75) AS qb FROM v GROUP BY 1),
md AS (SELECT series, quantile_cont(abs(y - med), 0.5) AS dv FROM v JOIN st USING (series) GROUP BY 1),
a AS (SELECT res.*, coalesce(CASE WHEN asd > 0 THEN round((y - am) / asd, 4) END, 0) AS z, coalesce(CASE WHEN dv > 0 THEN 0.6745 * (y - med) / dv END, 0) AS mz, greatest(qa - 1.5 * (qb - qa) - y, y - (qb + 1.5 * (qb - qa)), 0) AS far, qb - qa AS wide FROM res JOIN st USING (series) JOIN md USING (series)),
c AS (SELECT *, concat_ws(',', CASE WHEN rz > 3 THEN 'residual' END, CASE WHEN abs(mz) > 3.5 THEN 'mad' END, CASE WHEN far > 0 THEN 'iqr' END) AS methods,
 greatest(CASE WHEN rz > 3 THEN {_CLIP.format('rz / 6.0')} ELSE 0 END, CASE WHEN abs(mz) > 3.5 THEN {_CLIP.format('abs(mz) / 7.0')} ELSE 0 END, CASE WHEN far > 0 THEN {_CLIP.format('far / (wide + 1e-6)')} ELSE 0 END) AS score FROM a),
consensus AS (SELECT series, event_id, ts, y, round(expected, 4) AS expected, CAST(score AS DOUBLE) AS score, methods, methods <> '' AS is_anomaly, CASE WHEN methods <> '' THEN {_severity('score', 'z')} ELSE 'NORMAL' END AS severity FROM c)"""


def consensus(spark, d) -> DataFrame:
    return anomaly.consensus(events(spark, d), K, "ts", Y)


@query("anomaly_consensus", f"{_CONSENSUS} SELECT series, event_id, y, score, methods, severity FROM consensus WHERE is_anomaly")
def _(spark, d):
    return consensus(spark, d).where("is_anomaly").select("series", "event_id", "y", "score", "methods", "severity")


@query("anomaly_timeline", f"{_CONSENSUS} SELECT series, event_id, y, expected, is_anomaly, severity FROM consensus")
def _(spark, d):
    return consensus(spark, d).select("series", "event_id", "y", "expected", "is_anomaly", "severity")


@query("anomaly_summary", f"{_CONSENSUS}, s AS (SELECT series, count(*) AS points, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM consensus GROUP BY 1) SELECT *, round(100 * anomalies / points, 2) AS pct FROM s")
def _(spark, d):
    return anomaly.summary(consensus(spark, d), K)


def far_above(df: DataFrame, keys: list[str], ts: str, y: str) -> DataFrame:
    """A detector that a user might add: values over three times the mean of their series; the score is the mean's share that is missing to the value."""
    rows = df.join(df.groupBy(*keys).agg(F.avg(y).alias("mean_")), keys)
    over = (F.col("mean_") > 0) & (F.col(y) > 3 * F.col("mean_"))
    return rows.withColumns({"far_above_flag": over, "far_above_score": F.when(over, F.round(1 - F.col("mean_") / F.col(y), 4)).otherwise(0.0)}).drop("mean_")


@query("anomaly_detectors", f"""WITH {_V}, s AS (SELECT series, avg(y) AS m, stddev_samp(y) AS sd, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM v GROUP BY 1),
z AS (SELECT event_id, y, m, coalesce(CASE WHEN sd > 0 THEN abs(y - m) / sd END, 0) AS z, greatest(a - 1.5 * (b - a) - y, y - (b + 1.5 * (b - a)), 0) AS far, b - a AS wide FROM v JOIN s USING (series)),
c AS (SELECT event_id, concat_ws(',', CASE WHEN z > 3 THEN 'zscore' END, CASE WHEN far > 0 THEN 'iqr' END, CASE WHEN m > 0 AND y > 3 * m THEN 'far_above' END) AS methods, CAST((z > 3)::INT + (far > 0)::INT + (m > 0 AND y > 3 * m)::INT AS INTEGER) AS votes,
 greatest(CASE WHEN z > 3 THEN {_CLIP.format('z / 6.0')} ELSE 0 END, CASE WHEN far > 0 THEN {_CLIP.format('far / (wide + 1e-6)')} ELSE 0 END, CASE WHEN m > 0 AND y > 3 * m THEN round(1 - m / y, 4) ELSE 0 END) AS score FROM z)
SELECT event_id, methods, votes, CAST(score AS DOUBLE) AS score FROM c WHERE votes > 0""")
def _(spark, d):
    anomaly.add_detector("far_above", far_above)
    rows = anomaly.detect(events(spark, d), K, "ts", Y, ["zscore", "iqr", "far_above"])
    return rows.where("votes > 0").select("event_id", "methods", "votes", "score")
