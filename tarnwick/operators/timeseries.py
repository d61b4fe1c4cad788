"""Time series: detection and profiles, window features, sequences and splits, for many series at once.

Every window has the series key; order is (ts, tie-breaker). Rolling features look at past rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from ..functions.columns import any_match, correlation, normalize_nulls

#: Name parts of time columns.
TIME_NAMES = ["date", "time", "timestamp", "created_at", "updated_at", "event_time", "transaction_date", "datetime", "day", "month", "year"]
LAGS, WINDOWS = (1, 2, 3, 7, 14), (7, 14, 30)


def time_column_candidates(df: DataFrame) -> DataFrame:
    """``(column, score)`` of 0.35 or more: +0.4 for the name; +0.6 for a time type, or half the share of texts that parse if that is 80 % or more, or 0.35 for whole numbers that are epoch seconds or milliseconds."""
    parts = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            kind = F.lit(0.6)
        elif isinstance(f.dataType, T.StringType):
            ok = F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")))
            share = F.count(ok) / F.greatest(F.count(c), F.lit(1))
            kind = F.when(share >= 0.8, 0.5 * share).otherwise(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            low, high = F.min(c), F.max(c)
            kind = F.when(low.between(9e7, 4e9) & high.between(9e7, 4e9) | low.between(9e10, 4e12) & high.between(9e10, 4e12), 0.35).otherwise(0.0)
        else:
            kind = F.lit(0.0)
        named = F.lit(0.4 if any_match(f.name, TIME_NAMES) else 0.0)
        parts.append(F.struct(F.lit(f.name).alias("column"), F.round(F.least(F.lit(1.0), named + kind), 4).alias("score")))
    return df.agg(F.array(*parts).alias("c")).select(F.inline("c")).where("score >= 0.35")


def ordered(keys: list[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def temporal_profile(df: DataFrame, keys: list[str], ts: str, arrival: str | None = None) -> DataFrame:
    """``(keys, n, start, end, duplicates, median_seconds, frequency, regular, missing_intervals[, monotonic])`` per series; ``monotonic`` needs the column that holds the order of arrival."""
    rows = df.where(F.col(ts).isNotNull())
    delta = (_micros(ts) - F.lag(_micros(ts)).over(ordered(keys, ts))) / 1e6
    rows = rows.withColumn("d_", delta)
    aggs = [F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"), (F.count("*") - F.count_distinct(ts)).alias("duplicates"), F.percentile("d_", F.lit(0.5)).alias("m"), F.stddev_samp("d_").alias("s")]
    if arrival:
        rows = rows.withColumn("back_", _micros(ts) < F.lag(_micros(ts)).over(ordered(keys, arrival)))
        aggs.append((F.count_if("back_") == 0).alias("monotonic"))
    m, s = F.col("m"), F.col("s")
    near = lambda a, b: m.between(a, b)
    span = (_micros("end") - _micros("start")) / 1e6
    return rows.groupBy(*keys).agg(*aggs).select(
        *keys, "n", "start", "end", "duplicates", F.round(m, 3).alias("median_seconds"),
        F.when(near(50, 70), "1min").when(near(3300, 3900), "1H").when(near(82800, 90000), "1D").when(near(590000, 620000), "1W").when(near(2400000, 2700000), "1M").otherwise("IRREGULAR").alias("frequency"),
        F.coalesce(s < 0.1 * m, F.lit(False)).alias("regular"),
        F.greatest(F.lit(0), F.coalesce(F.when(m > 0, F.floor(span / m) - F.col("n") + 1), F.lit(0))).alias("missing_intervals"),
        *(["monotonic"] if arrival else []),
    )


def autocorrelations(df: DataFrame, keys: list[str], ts: str, y: str, lags: list[int]) -> DataFrame:
    """``(keys, lag, r)``: Pearson of y with its lag; NULL where undefined."""
    w = ordered(keys, ts)
    rows = normalize_nulls(df).select(*keys, F.col(y).alias("y"), *[F.lag(y, k).over(w).alias(f"l{k}") for k in lags])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), correlation(F.col("y").cast("double"), F.col(f"l{k}").cast("double")).alias("r")) for k in lags])
    return rows.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.inline("p")).withColumn("r", F.round("r", 4))


def trend(df: DataFrame, keys: list[str], ts: str, y: str) -> DataFrame:
    """``(keys, slope, trend)``: least squares on the row's place; slope over the mean of |y| beyond 0.002 either way is UPWARD or DOWNWARD."""
    rows = df.withColumn("at_", F.row_number().over(ordered(keys, ts)))
    by = rows.groupBy(*keys).agg(F.regr_slope(y, "at_").alias("slope"), F.avg(F.abs(y)).alias("size"))
    rel = F.col("slope") / (F.col("size") + 1e-9)
    return by.select(*keys, F.round("slope", 6).alias("slope"), F.when(rel > 0.002, "UPWARD").when(rel < -0.002, "DOWNWARD").otherwise("STATIONARY").alias("trend"))


def seasonality(df: DataFrame, keys: list[str], ts: str, y: str, most: int = 30) -> DataFrame:
    """``(keys, period, strength)``: of the lags from 2 to the lesser of ``most`` and half the rows the one with the highest autocorrelation over 0.35, the first of equal ones; else NULL."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    acf = autocorrelations(df, keys, ts, y, list(range(2, most + 1))).join(n, keys).where("lag <= floor(n / 2) and r > 0.35")
    best = acf.groupBy(*keys).agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.col("lag"))).alias("b"))
    return n.join(best, keys, "left").select(*keys, F.col("b.lag").alias("period"), F.coalesce("b.r", F.lit(0.0)).alias("strength"))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Parts of the time as columns; a time column that has the name of one of them is a ValueError."""
    c = F.col(ts)
    parts = {"year": F.year(c), "month": F.month(c), "day": F.day(c), "dayofweek": F.weekday(c), "dayofyear": F.dayofyear(c), "quarter": F.quarter(c), "is_weekend": (F.weekday(c) >= 5).cast("int"), "hour": F.hour(c), "minute": F.minute(c)}
    if ts in parts:
        raise ValueError(f"the time column is named like its part {ts}")
    return df.withColumns(parts)


def lags(df: DataFrame, keys: list[str], ts: str, columns: list[str], ks: tuple[int, ...] = LAGS) -> DataFrame:
    """``<column>_lag_k`` of each column."""
    w = ordered(keys, ts)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in ks})


def rolling(df: DataFrame, keys: list[str], ts: str, y: str, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``roll_{mean,std,min,max}_w`` over the w rows before the row; an undefined deviation is 0."""
    out = {}
    for n in windows:
        w = ordered(keys, ts).rowsBetween(-n, -1)
        out |= {f"roll_mean_{n}": F.avg(y).over(w), f"roll_std_{n}": F.coalesce(F.stddev_samp(y).over(w), F.lit(0.0)), f"roll_min_{n}": F.min(y).over(w), f"roll_max_{n}": F.max(y).over(w)}
    return df.withColumns(out)


def expanding(df: DataFrame, keys: list[str], ts: str, y: str) -> DataFrame:
    return df.withColumn("expanding_mean", F.avg(y).over(ordered(keys, ts).rowsBetween(Window.unboundedPreceding, -1)))


def differences(df: DataFrame, keys: list[str], ts: str, y: str) -> DataFrame:
    """``diff_1`` and ``pct_1`` of the lagged series; undefined ones are 0."""
    w = ordered(keys, ts)
    a, b = F.lag(y, 1).over(w), F.lag(y, 2).over(w)
    return df.withColumns({"diff_1": F.coalesce(a - b, F.lit(0.0)), "pct_1": F.coalesce(F.when(b != 0, (a - b) / b), F.lit(0.0))})


def features(df: DataFrame, keys: list[str], ts: str, y: str, covariates: list[str] | None = None) -> DataFrame:
    """All of the above in one sort: calendar, lags, rolling and expanding statistics, differences, lag 1 of covariates."""
    out = expanding(rolling(lags(calendar(df, ts), keys, ts, [y]), keys, ts, y), keys, ts, y)
    out = differences(out, keys, ts, y)
    return lags(out, keys, ts, covariates, (1,)) if covariates else out


def sequences(df: DataFrame, keys: list[str], ts: str, y: str, past: int, ahead: int) -> DataFrame:
    """``(keys, ts, x, target)``: every full window of ``past`` values up to the row and the ``ahead`` that follow."""
    w = ordered(keys, ts)
    rows = df.select(*keys, ts, F.collect_list(y).over(w.rowsBetween(1 - past, 0)).alias("x"), F.collect_list(y).over(w.rowsBetween(1, ahead)).alias("target"))
    return rows.where((F.size("x") == past) & (F.size("target") == ahead))


def standardize(df: DataFrame, keys: list[str], ts: str, y: str, share: float = 0.8) -> DataFrame:
    """``y_scaled`` by mean and population deviation of the first ``share`` of each series; a deviation of 0 counts as 1."""
    w = ordered(keys, ts)
    rows = df.withColumns({"at_": F.row_number().over(w), "n_": F.count("*").over(Window.partitionBy(*keys))})
    early = F.col("at_") <= F.floor(F.col("n_") * share)
    stats = rows.groupBy(*keys).agg(F.avg(F.when(early, F.col(y))).alias("mean_"), F.stddev_pop(F.when(early, F.col(y))).alias("sd_"))
    scaled = (F.col(y) - F.col("mean_")) / F.when(F.col("sd_") > 0, F.col("sd_")).otherwise(1.0)
    return rows.join(stats, keys).withColumn("y_scaled", scaled).drop("at_", "n_", "mean_", "sd_")


def holdout(df: DataFrame, keys: list[str], ts: str, ahead: int) -> DataFrame:
    """``part``: ``validation`` for the last ``ahead`` rows of each series, else ``train``."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    return df.withColumn("part", F.when(back <= ahead, "validation").otherwise("train"))


def future_timestamps(df: DataFrame, keys: list[str], ts: str, ahead: int) -> DataFrame:
    """``(keys, step, ts)``: the last time and as many of its last distances after it as asked for; one row alone goes on by days."""
    top = df.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).where("r_ <= 2").groupBy(*keys).agg(F.max(_micros(ts)).alias("last"), F.min(_micros(ts)).alias("before"))
    step = F.when(F.col("last") > F.col("before"), F.col("last") - F.col("before")).otherwise(86_400_000_000)
    return top.select(*keys, "last", step.alias("by"), F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step")).select(*keys, "step", F.timestamp_micros(F.col("last") + F.col("by") * F.col("step")).alias(ts))
