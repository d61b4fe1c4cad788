"""Drift between two tables: PSI on reference quantile bins, Kolmogorov-Smirnov, and the report over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut
from ..functions.ranges import exact_quantiles, running_sums
from .profile import long_numeric


def shared_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    from ..functions.columns import numeric_columns

    other = set(numeric_columns(current))
    return [c for c in numeric_columns(reference) if c in other]


def psi(reference: DataFrame, current: DataFrame, columns: list[str], buckets: int = 10) -> DataFrame:
    """``(column, psi)``: reference quantile bins (unique edges; fewer than 2 give 0); current values beyond the reference's range fill no bin but count in the total; empty bins count as 1e-8."""
    a, b = (long_numeric(d, columns).where("value is not null") for d in (reference, current))
    edges = cut(exact_quantiles(a, ["column"], "value", [i / buckets for i in range(buckets + 1)]).select("column", F.array_distinct("q").alias("edges")))
    bin_ = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1)
    inside = (F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1))

    def counts(long: DataFrame, name: str) -> DataFrame:
        rows = long.join(F.broadcast(edges), "column").withColumn("bin", F.when(inside, bin_))
        return rows.groupBy("column", "bin").agg(F.count("*").alias(name))

    totals = lambda long, name: long.groupBy("column").agg(F.count("*").alias(name))
    every = edges.where(F.size("edges") >= 2).select("column", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    rows = every.join(counts(a, "x"), ["column", "bin"], "left").join(counts(b, "y"), ["column", "bin"], "left").join(totals(a, "nx"), "column").join(totals(b, "ny"), "column", "left")
    p = F.greatest(F.coalesce(F.col("x"), F.lit(0)) / F.col("nx"), F.lit(1e-8))
    q = F.greatest(F.coalesce(F.coalesce(F.col("y"), F.lit(0)) / F.col("ny"), F.lit(0.0)), F.lit(1e-8))
    out = rows.groupBy("column").agg(F.round(F.abs(F.sum((q - p) * F.log(q / p))), 4).alias("psi"))
    return edges.select("column").join(out, "column", "left").select("column", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sided p-value."""
    root = F.sqrt(F.try_divide(n * m, n + m))
    lam = (root + 0.12 + F.try_divide(F.lit(0.11), root)) * d
    total = sum((2 * (-1) ** (j - 1) * F.exp(-2 * j * j * lam * lam) for j in range(1, 51)), F.lit(0.0))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, ks, p_value)``: counts by distinct value, running shares of both sides, range by range."""
    a, b = (long_numeric(d, columns).where("value is not null") for d in (reference, current))
    both = a.withColumns({"x": F.lit(1), "y": F.lit(0)}).union(b.withColumns({"x": F.lit(0), "y": F.lit(1)})).groupBy("column", "value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    totals = both.groupBy("column").agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    run = running_sums(both, ["column"], "value", ["x", "y"]).join(F.broadcast(totals), "column")
    gap = F.abs(F.try_divide("x_upto", "n") - F.try_divide("y_upto", "m"))
    out = run.groupBy("column").agg(F.max(gap).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    return out.select("column", F.round("d", 6).alias("ks"), F.round(ks_p_value(F.col("d"), F.col("n"), F.col("m")), 6).alias("p_value"))


def report(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, mean_ref, mean_cur, std_ref, std_cur, shift_pct, psi, ks, p_value, level, alert)`` of the shared numeric columns with 10 values or more on each side; population deviations."""
    columns = columns or shared_columns(reference, current)
    side = lambda d, s: long_numeric(d, columns).groupBy("column").agg(F.count("value").alias(f"n_{s}"), F.avg("value").alias(f"m_{s}"), F.stddev_pop("value").alias(f"s_{s}"))
    rows = side(reference, "r").join(side(current, "c"), "column").where("n_r >= 10 and n_c >= 10").join(psi(reference, current, columns), "column").join(ks(reference, current, columns), "column")
    p = F.col("psi")
    return rows.select(
        "column", F.round("m_r", 4).alias("mean_ref"), F.round("m_c", 4).alias("mean_cur"), F.round("s_r", 4).alias("std_ref"), F.round("s_c", 4).alias("std_cur"),
        F.round(100 * (F.col("m_c") - F.col("m_r")) / (F.abs("m_r") + 1e-8), 2).alias("shift_pct"), "psi", "ks", "p_value",
        F.when(p < 0.1, "none").when(p < 0.2, "minor").when(p < 0.3, "moderate").otherwise("major").alias("level"), ((p >= 0.2) | (F.col("p_value") <= 0.05)).alias("alert"),
    )


def overall(report_: DataFrame) -> DataFrame:
    """``(mean_psi, level, drifted, stable, alert)``: lists in order."""
    names = lambda cond: F.concat_ws(",", F.array_sort(F.collect_list(F.when(cond, F.col("column")))))
    out = report_.agg(F.round(F.avg("psi"), 4).alias("mean_psi"), names(F.col("alert")).alias("drifted"), names(~F.col("alert")).alias("stable"), F.coalesce(F.max("alert"), F.lit(False)).alias("alert"))
    p = F.col("mean_psi")
    return out.withColumn("level", F.when(p < 0.1, "none").when(p < 0.2, "minor").when(p < 0.3, "moderate").otherwise("major"))
