"""Quality: missing values, duplicates, constants, outliers, skew, invalid values, the score and what to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import normalize_nulls
from ..functions.ranges import exact_quantiles
from .profile import long_numeric, value_counts

#: Weights of the score's parts and how hard each kind of fault counts.
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.25, "validity": 0.20, "consistency": 0.10, "outlier_score": 0.10}
PENALTY = {"completeness": 1.0, "uniqueness": 2.0, "validity": 3.0, "consistency": 2.5, "outlier_score": 1.5}
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"


def missing(schema: DataFrame) -> DataFrame:
    """``(column, inferred_type, null_count, null_pct, severity)`` of the columns with NULLs, from a schema report."""
    p = F.col("null_pct")
    return schema.where("null_count > 0").select("column", "inferred_type", "null_count", "null_pct", F.when(p > 30, "CRITICAL").when(p > 10, "HIGH").when(p > 2, "MEDIUM").otherwise("LOW").alias("severity"))


def duplicates(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """``(duplicate_rows)``: rows beyond the first of each; if there are none, the most repeated ids of an id column."""
    whole = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))
    if not id_columns:
        return whole.select(F.col("rows").alias("duplicate_rows"))
    counts = value_counts(df, id_columns).groupBy("column").agg((F.sum("n") - F.count("*")).alias("extra")).agg(F.max("extra").alias("extra"))
    return whole.crossJoin(F.broadcast(counts)).select(F.when(F.col("rows") > 0, F.col("rows")).otherwise(F.coalesce("extra", F.lit(0))).alias("duplicate_rows"))


def constants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, kind, top_share)``: ``constant`` with one distinct value, ``near_constant`` with 99 % or more of one; shares of non-NULL rows."""
    by = value_counts(df, columns).where("value is not null").groupBy("column").agg(F.count("*").alias("uniques"), F.max("n").alias("top"), F.sum("n").alias("rows"))
    share = F.col("top") / F.col("rows")
    return by.where((F.col("uniques") == 1) | (share >= 0.99)).select("column", F.when(F.col("uniques") == 1, "constant").otherwise("near_constant").alias("kind"), F.round(share, 4).alias("top_share"))


def outliers(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """``(column, outliers, pct, low, high)`` of the columns that have some: outside 1.5 quartile distances, from 4 values on."""
    df = normalize_nulls(df)
    long = long_numeric(df, columns)
    q = long.groupBy("column").agg(F.percentile_approx("value", [0.25, 0.75], accuracy).alias("q")) if accuracy else exact_quantiles(long, ["column"], "value", [0.25, 0.75])
    wide = 1.5 * (F.col("q")[1] - F.col("q")[0])
    fences = q.select("column", (F.col("q")[0] - wide).alias("low"), (F.col("q")[1] + wide).alias("high"))
    rows = long.join(F.broadcast(fences), "column").groupBy("column", "low", "high").agg(F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outliers"), F.count("value").alias("filled"), F.count("*").alias("rows"))
    return rows.where("outliers > 0 and filled >= 4").select("column", "outliers", F.round(100 * F.col("outliers") / F.col("rows"), 2).alias("pct"), F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


def adjusted_skewness(c: Column) -> Column:
    """The sample skewness: the population's times sqrt(n (n - 1)) / (n - 2)."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def skewed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, skewness, direction)`` where the sample skewness is over 1 either way."""
    df = normalize_nulls(df)
    parts = [F.struct(F.lit(c).alias("column"), F.round(adjusted_skewness(F.col(c)), 3).alias("skewness")).alias(c) for c in columns]
    rows = df.agg(*parts).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))
    return rows.where("abs(skewness) > 1").withColumn("direction", F.when(F.col("skewness") > 0, "right").otherwise("left"))


def default_rules(columns: list[str]) -> list[tuple[str, str, Column]]:
    """(column, rule, condition of a bad value): ages under 0 or over 130, addresses that are none."""
    ages = [(c, "age_range", (F.col(c) < 0) | (F.col(c) > 130)) for c in columns if "age" in c.lower()]
    mails = [(c, "email_format", ~F.trim(F.col(c)).rlike(EMAIL)) for c in columns if "email" in c.lower()]
    return ages + mails


def invalid(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """``(column, rule, invalid_count)`` of the rules that some value breaks; NULL breaks none."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.count_if(bad).alias("invalid_count")) for c, rule, bad in rules]
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r")).where("invalid_count > 0")


def score(counts: DataFrame) -> DataFrame:
    """The score of rows of counts: total_cells, total_nulls, total_rows, duplicate_rows, invalid_cells, constant_columns, total_columns, outlier_cells. Columns ``completeness, uniqueness, validity, consistency, outlier_score, overall_score, grade``, one decimal."""
    shares = {"completeness": ("total_nulls", "total_cells"), "uniqueness": ("duplicate_rows", "total_rows"), "validity": ("invalid_cells", "total_cells"), "consistency": ("constant_columns", "total_columns"), "outlier_score": ("outlier_cells", "total_cells")}
    part = {k: F.greatest(F.lit(0.0), 100 - 100 * PENALTY[k] * F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)) for k, (a, b) in shares.items()}
    total = reduce(lambda x, y: x + y, [WEIGHTS[k] * part[k] for k in part])
    grade = F.when(total >= 90, "A").when(total >= 80, "B").when(total >= 70, "C").otherwise("D")
    return counts.select(*[F.round(v, 1).alias(k) for k, v in part.items()], F.round(total, 1).alias("overall_score"), grade.alias("grade"))


def score_table(df: DataFrame, schema: DataFrame, id_columns: list[str], numeric: list[str]) -> DataFrame:
    """The score of a table, from the reports above."""
    nulls = schema.agg(F.sum("null_count").alias("total_nulls"), F.count("*").alias("total_columns"))
    rows = df.agg(F.count("*").alias("total_rows"))
    rules = default_rules(df.columns)
    bad = invalid(df, rules).agg(F.coalesce(F.sum("invalid_count"), F.lit(0)).alias("invalid_cells")) if rules else df.sparkSession.range(1).select(F.lit(0).alias("invalid_cells"))
    flat = constants(df).agg(F.count_if(F.col("kind") == "constant").alias("constant_columns"))
    out = outliers(df, numeric).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outlier_cells"))
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [rows, nulls, duplicates(df, id_columns), bad, flat, out])
    return score(one.withColumn("total_cells", F.col("total_rows") * F.col("total_columns")))


def recommendations(missing_report: DataFrame, constant_report: DataFrame, duplicate_report: DataFrame, outlier_report: DataFrame) -> DataFrame:
    """``(column, issue_type, severity, action)``."""
    row = lambda df, column, issue, severity, action: df.select(column.alias("column"), *[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("issue_type", issue), ("severity", severity), ("action", action))])
    c, high, number = F.col("column"), F.col("null_pct") > 60, F.col("inferred_type") == "NUMERICAL"
    pick = lambda a, b, d: F.when(high, a).when(number, b).otherwise(d)
    gaps = missing_report.where(high | F.col("inferred_type").isin("NUMERICAL", "CATEGORICAL", "TEXT"))
    parts = [
        row(gaps, c, pick("HIGH_MISSINGNESS", "NUMERICAL_MISSINGNESS", "CATEGORICAL_MISSINGNESS"), pick("HIGH", "MEDIUM", "LOW"), pick("DROP_COLUMN", "MEDIAN_IMPUTE", "MODE_IMPUTE")),
        row(constant_report.where("kind = 'constant'"), c, "ZERO_VARIANCE", "MEDIUM", "DROP_COLUMN"),
        row(duplicate_report.where("duplicate_rows > 0"), F.lit(None).cast("string"), "DUPLICATE_RECORDS", "MEDIUM", "DEDUPLICATE"),
        row(outlier_report.where("pct > 2"), c, "NUMERICAL_OUTLIERS", "LOW", "INVESTIGATE_AND_CLIP"),
    ]
    return reduce(DataFrame.unionByName, parts)


def readiness(scored: DataFrame) -> DataFrame:
    """``(overall_score, readiness)``: READY from 80, WARNING from 60, else UNFIT."""
    s = F.col("overall_score")
    return scored.select("overall_score", F.when(s >= 80, "READY").when(s >= 60, "WARNING").otherwise("UNFIT").alias("readiness"))
