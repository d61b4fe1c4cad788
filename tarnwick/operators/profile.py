"""Semantic schema and column profiles as long tables: a row for each column, bin or value.

``value_counts`` is the one shuffle that serves unique counts, top values, constants and types together.
Quantiles and unique counts are exact and distributed; ``accuracy`` switches to sketches in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.ranges import exact_quantiles
from ..functions.columns import DATES, FLOATS, ID_NAMES, TRUTHS, any_match, normalize_nulls, numeric_columns, tidy


def _kind(t: T.DataType) -> str:
    for name, types in (("boolean", (T.BooleanType,)), ("datetime", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("float", (*FLOATS, T.DecimalType)), ("integer", (T.IntegralType,)), ("string", (T.StringType,))):
        if isinstance(t, types):
            return name
    return "other"


def long_numeric(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``(keep..., column, value double)``: numeric columns below each other."""
    df = normalize_nulls(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*(keep or []), F.inline(pairs))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value string, n)`` for every distinct value, NULL too."""
    columns = columns or df.columns
    df = normalize_nulls(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def detect_schema(df: DataFrame, samples: int = 5) -> DataFrame:
    """``(position, column, inferred_type, dtype, null_count, null_pct, unique_count, unique_pct, samples)`` for each column.

    Rules in order: all NULL is UNKNOWN; an identifier-like name with a unique ratio over 0.85 or more than 500
    uniques IDENTIFIER; booleans, or up to two values that are all truth words, BOOLEAN; times, or texts of which
    over 80 % look like dates, DATETIME; numbers of at most 10 uniques and a ratio under 0.05 CATEGORICAL, else
    NUMERICAL; texts of a mean length over 35 TEXT; up to 50 uniques or a ratio under 0.15 CATEGORICAL; a ratio
    over 0.9 IDENTIFIER; the rest CATEGORICAL. Samples are the least values, as text. The date rule looks at all rows.
    """
    spark = df.sparkSession
    counts = value_counts(df)
    v, n = F.col("value"), F.col("n")
    has = v.isNotNull()
    looks = F.greatest(*[v.rlike(p).cast("int") for p in DATES])
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~has, n)), F.lit(0)).alias("null_count"),
        F.count_if(has).alias("unique_count"),
        F.sum(F.when(has, F.length(v) * n)).alias("chars"),
        F.coalesce(F.sum(F.when(has, looks * n)), F.lit(0)).alias("dates"),
        F.min(F.when(has, F.lower(v).isin(TRUTHS).cast("int"))).alias("truths"),
    )
    first = counts.where(has).withColumn("at", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("at") <= samples)
    first = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("samples"))
    names = spark.createDataFrame([(i, f.name, _kind(f.dataType), f.dataType.simpleString(), any_match(f.name, ID_NAMES)) for i, f in enumerate(df.schema)], "position int, column string, kind string, dtype string, id_name boolean")
    filled = F.col("rows") - F.col("null_count")
    ratio = F.col("unique_count") / F.greatest(filled, F.lit(1))
    kind, u, is_id = F.col("kind"), F.col("unique_count"), F.col("id_name")
    number = kind.isin("integer", "float")
    inferred = (
        F.when(filled == 0, "UNKNOWN")
        .when(is_id & ((ratio > 0.85) | (u > 500)), "IDENTIFIER")
        .when((kind == "boolean") | ((u <= 2) & (F.col("truths") == 1)), "BOOLEAN")
        .when((kind == "datetime") | ((kind == "string") & (F.col("dates") / filled > 0.8)), "DATETIME")
        .when(number & (u <= 10) & (ratio < 0.05) & ~is_id, "CATEGORICAL")
        .when(number, "NUMERICAL")
        .when(F.col("chars") / filled > 35, "TEXT")
        .when((u <= 50) | (ratio < 0.15), "CATEGORICAL")
        .when(ratio > 0.9, "IDENTIFIER")
        .otherwise("CATEGORICAL")
    )
    pct = lambda c: F.round(100 * c / F.greatest(F.col("rows"), F.lit(1)), 2)
    return (
        names.join(F.broadcast(stats), "column", "left")
        .join(F.broadcast(first), "column", "left")
        .withColumns({"rows": F.coalesce("rows", F.lit(0)), "null_count": F.coalesce("null_count", F.lit(0)), "unique_count": F.coalesce("unique_count", F.lit(0))})
        .select("position", "column", inferred.alias("inferred_type"), "dtype", "null_count", pct(F.col("null_count")).alias("null_pct"), "unique_count", pct(u).alias("unique_pct"), F.coalesce("samples", F.lit("")).alias("samples"))
    )


def schema_summary(schema: DataFrame) -> DataFrame:
    return schema.groupBy("inferred_type").agg(F.count("*").alias("columns"))


def profile_numeric(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """``(column, count, nulls, uniques, min, max, mean, median, std, variance, q25, q75, iqr, skewness, kurtosis)``; sample deviation, population skewness (over 2 rows) and excess kurtosis (over 3), four decimals."""
    df = normalize_nulls(df)
    columns = columns or numeric_columns(df)
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        sketch = [F.approx_count_distinct(x).alias("uniques"), F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias("q")] if accuracy else []
        parts.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), *sketch).alias(c))
    rows = df.agg(*parts).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))
    if not accuracy:
        long = long_numeric(df, columns).where("value is not null")
        uniques = long.distinct().groupBy("column").agg(F.count("*").alias("uniques"))
        rows = rows.join(F.broadcast(uniques), "column", "left").join(F.broadcast(exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])), "column", "left").withColumn("uniques", F.coalesce("uniques", F.lit(0)))
    r = lambda e, name: tidy(e).alias(name)
    q = F.col("q")
    return rows.select(
        "column", "count", "nulls", "uniques", *[r(F.col(c), c) for c in ("min", "max", "mean")], r(q[1], "median"), r(F.col("std"), "std"), r(F.col("variance"), "variance"), r(q[0], "q25"), r(q[2], "q75"), r(q[2] - q[0], "iqr"),
        r(F.when(F.col("count") > 2, F.col("skewness")), "skewness"), r(F.when(F.col("count") > 3, F.col("kurtosis")), "kurtosis"),
    )


def histogram(df: DataFrame, columns: list[str], bins: int | None = None) -> DataFrame:
    """``(column, bin, low, high, count)``: equal-width bins, the last closed, empty ones too. Without ``bins`` as many as uniques, 5 at least and 15 at most. A constant v spreads over v - 0.5 to v + 0.5."""
    long = long_numeric(df, columns).where("value is not null")
    n = F.lit(bins) if bins else F.least(F.lit(15), F.greatest(F.lit(5), F.count_distinct("value")))
    edges = long.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b"), (n if bins is None else F.first(n)).cast("int").alias("bins"))
    flat = F.col("a") == F.col("b")
    edges = edges.select("column", F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"), "bins")
    at = F.least(F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * F.col("bins")), F.col("bins") - 1).cast("int")
    counts = long.join(F.broadcast(edges), "column").groupBy("column", at.alias("bin")).agg(F.count("*").alias("n"))
    wide = (F.col("b") - F.col("a")) / F.col("bins")
    every = edges.select("column", "a", "b", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, ["column", "bin"], "left").select("column", "bin", F.round(F.col("a") + wide * F.col("bin"), 4).alias("low"), F.round(F.col("a") + wide * (F.col("bin") + 1), 4).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """``(column, rank, value, count, pct, cardinality)``: the most frequent values, ties by value; percent of all rows, NULLs too."""
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.count_if(F.col("value").isNotNull()).alias("cardinality"))
    ranked = counts.where("value is not null").withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(totals), "column").select("column", "rank", "value", F.col("n").alias("count"), F.round(100 * F.col("n") / F.col("rows"), 2).alias("pct"), "cardinality")


def profile_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, avg_length, min_length, max_length, blank_count)``; lengths in characters."""
    parts = [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.length(c)), 2).alias("avg_length"), F.min(F.length(c)).alias("min_length"), F.max(F.length(c)).alias("max_length"), F.count_if(F.trim(F.col(c)) == "").alias("blank_count")).alias(c) for c in columns]
    return df.agg(*parts).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def profile_datetime(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, min, max, range_days)``; whole days."""
    days = lambda c: F.floor((F.unix_micros(F.max(F.col(c).cast("timestamp"))) - F.unix_micros(F.min(F.col(c).cast("timestamp")))) / 86_400_000_000)
    parts = [F.struct(F.lit(c).alias("column"), F.min(c).cast("timestamp").alias("min"), F.max(c).cast("timestamp").alias("max"), days(c).alias("range_days")).alias(c) for c in columns]
    return df.agg(*parts).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def profile_dataset(df: DataFrame) -> DataFrame:
    """``(row_count, column_count, approx_bytes)``: bytes are those of all values as text."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"), F.coalesce(F.sum(width), F.lit(0)).alias("approx_bytes"))
