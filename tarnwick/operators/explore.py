"""Exploration: correlations, distributions, insights, their verification, and tables behind charts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import normalize_nulls
from ..functions.ranges import running_sums
from ..functions.substrings import containing
from .profile import histogram, long_numeric, top_values, value_counts
from .quality import adjusted_skewness


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column replaced by its average rank among non-NULLs, ties alike: counts by value, then running sums."""
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        upto = running_sums(counts, [], c, ["n"]).select(F.col(c).alias("v_"), (F.col("n_upto") - (F.col("n") - 1) / 2).alias("r_"))
        df = df.join(upto, df[c] == upto["v_"], "left").drop("v_", c).withColumnRenamed("r_", c)
    return df


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """``(column_a, column_b, r)`` for every two columns over the rows where both are there, three decimals; undefined is 0.

    Each task multiplies its rows' centred values with each other as matrices, and only the sums of a pair go
    on: no aggregate a pair. Means are taken off first, so that the sums keep their digits.
    """
    df = normalize_nulls(df).select(*[F.col(c).cast("double").alias(c) for c in columns])
    if method == "spearman":
        df = average_ranks(df, columns)
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] or 0.0 for c in columns])

    def products(batches):
        total = np.zeros((6, len(columns), len(columns)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float) - centre
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(len(columns), 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    sums = df.mapInArrow(products, "i int, j int, n double, a double, b double, aa double, bb double, ab double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    part = lambda s, x, y: F.col(s) / n - F.col(x) / n * F.col(y) / n
    # what the digits cannot tell from 0 is no spread
    spread = lambda s, x: F.when(part(s, x, x) > 1e-14 * F.greatest(F.col(s) / n, F.lit(1e-280)), part(s, x, x))
    r = F.try_divide(part("ab", "a", "b"), F.sqrt(spread("aa", "a")) * F.sqrt(spread("bb", "b")))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    return sums.select(name("i").alias("column_a"), name("j").alias("column_b"), F.round(F.coalesce(r, F.lit(0.0)), 3).alias("r"))


def correlation_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """All ordered pairs, the diagonal too."""
    same = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "column_a string, column_b string, r double")
    both = F.array(F.struct("column_a", "column_b", "r"), F.struct(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r"))
    return pairs.select(F.inline(both)).unionByName(same)


def strong_pairs(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """``(column_a, column_b, r, strength, direction)`` with |r| of ``least`` or more."""
    size = F.abs("r")
    return pairs.where(size >= least).select("column_a", "column_b", "r", F.when(size >= 0.75, "STRONG").otherwise("MODERATE").alias("strength"), F.when(F.col("r") > 0, "POSITIVE").otherwise("NEGATIVE").alias("direction"))


def distribution_bins(df: DataFrame, columns: list[str]) -> DataFrame:
    return histogram(df, columns, 10)


def distribution_top(df: DataFrame, columns: list[str]) -> DataFrame:
    return top_values(df, columns, 8)


def eda_summary(df: DataFrame, schema: DataFrame) -> DataFrame:
    """``(rows, columns, numerical, categorical, datetime, text, identifier, boolean)``."""
    kinds = schema.agg(F.count("*").alias("columns"), *[F.count_if(F.col("inferred_type") == k.upper()).alias(k) for k in ("numerical", "categorical", "datetime", "text", "identifier", "boolean")])
    return df.agg(F.count("*").alias("rows")).crossJoin(F.broadcast(kinds))


def correlation_insights(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The strongest ``k`` pairs: ``(column_a, column_b, r, severity)``."""
    return strong_pairs(pairs).orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(k).select("column_a", "column_b", "r", F.when(F.abs("r") >= 0.75, "HIGH").otherwise("MEDIUM").alias("severity"))


def concentration_insights(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, skewness, top_share, severity)`` of right-skewed, never negative columns: percent of the total in the largest 5 % of the values.

    The cut is found on counts by value, with sums that run range by range.
    """
    long = long_numeric(df, columns).where("value is not null")
    stats = long.groupBy("column").agg(F.count("*").alias("n"), adjusted_skewness(F.col("value")).alias("skewness"), F.min("value").alias("low"), F.sum("value").alias("total"))
    fit = stats.where("n >= 10 and skewness > 1.5 and low >= 0 and total > 0").withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * 0.05)))
    counts = long.join(F.broadcast(fit.select("column")), "column", "left_semi").groupBy("column", "value").agg(F.count("*").alias("c"))
    above = F.col("n") - F.col("c_upto")
    held = running_sums(counts, ["column"], "value", ["c"]).join(F.broadcast(fit), "column").withColumn("use", F.greatest(F.lit(0), F.least("c", F.col("k") - above)))
    out = held.groupBy("column", "skewness", "total").agg(F.sum(F.col("use") * F.col("value")).alias("top"))
    share = F.round(100 * F.col("top") / F.col("total"), 1)
    return out.select("column", F.round("skewness", 3).alias("skewness"), share.alias("top_share"), F.when(share >= 30, "HIGH").otherwise("MEDIUM").alias("severity"))


def imbalance_insights(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, dominant, pct)`` of two-valued columns with 75 % or more of one value."""
    by = value_counts(df, columns).where("value is not null").groupBy("column").agg(F.count("*").alias("k"), F.max_by("value", F.struct("n", "value")).alias("dominant"), F.max("n").alias("top"), F.sum("n").alias("rows"))
    pct = F.round(100 * F.col("top") / F.col("rows"), 1)
    return by.where((F.col("k") == 2) & (pct >= 75)).select("column", "dominant", pct.alias("pct"))


def quality_insights(scored: DataFrame) -> DataFrame:
    s = F.col("overall_score")
    return scored.where(s < 85).select("overall_score", F.when(s < 70, "HIGH").otherwise("MEDIUM").alias("severity"))


def verify_insights(claims: DataFrame, pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """``(insight_id, status)`` of claims ``(insight_id, kind, value)``: a correlation within 0.01 of some entry, a score within 0.5, is VERIFIED; anything else UNSUPPORTED."""
    known = pairs.select(F.lit("correlation").alias("kind"), F.col("r").alias("truth"), F.lit(0.01).alias("room")).union(scored.select(F.lit("quality"), "overall_score", F.lit(0.5)))
    near = (claims["kind"] == known["kind"]) & (F.abs(claims["value"] - known["truth"]) <= known["room"])
    hit = claims.join(F.broadcast(known), near, "left_semi").select("insight_id").distinct().withColumn("status", F.lit("VERIFIED"))
    return claims.select("insight_id").distinct().join(hit, "insight_id", "left").select("insight_id", F.coalesce("status", F.lit("UNSUPPORTED")).alias("status"))


def match_claims(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """``claims(batch, claim_id, name, claimed)`` with ``actual`` of ``metrics(metric, value)``: the same name, else one that is alike in lower case or holds the other (the first by name)."""
    exact = metrics.select(F.col("metric").alias("name"), F.col("value").alias("exact")).dropDuplicates(["name"])
    low = metrics.select(F.lower("metric").alias("low"), "metric", "value")
    named = claims.select("batch", "claim_id", F.lower("name").alias("own"))
    a, b = low.select("low").distinct().withColumn("text", F.col("low")), named.select("own").distinct().withColumn("text", F.col("own"))
    alike = containing(a, "low", "text", b, "own").select("own", "low").union(containing(b, "own", "text", a, "low").select("own", "low")).distinct()
    loose = named.join(alike, "own").join(low, "low")
    best = loose.groupBy("batch", "claim_id").agg(F.min_by("value", F.struct((F.col("own") != F.col("low")).alias("off"), "metric")).alias("loose"))
    return claims.join(exact, "name", "left").join(best, ["batch", "claim_id"], "left").select("batch", "claim_id", "name", "claimed", F.coalesce("exact", "loose").alias("actual"))


def audit_claims(matched: DataFrame) -> DataFrame:
    """``(batch, claim_id, delta, status, confidence)``: 3 % off is SUPPORTED, 10 % PARTIALLY_SUPPORTED, more or no metric REJECTED."""
    delta = F.when(F.col("actual") == 0, F.abs("claimed")).otherwise(F.abs(F.col("claimed") - F.col("actual")) / F.abs("actual"))
    rows = matched.withColumn("delta", F.round(delta, 6))
    d = F.col("delta")
    return rows.select(
        "batch", "claim_id", "delta",
        F.when(d <= 0.03, "SUPPORTED").when(d <= 0.10, "PARTIALLY_SUPPORTED").otherwise("REJECTED").alias("status"),
        F.when(d.isNull(), 0.0).when(d <= 0.03, F.greatest(F.lit(0.95), 1 - d)).when(d <= 0.10, 0.70).otherwise(0.20).alias("confidence"),
    )


def audit_verdicts(audited: DataFrame) -> DataFrame:
    """``(batch, claims, supported, rejected, verdict, confidence)``."""
    by = audited.groupBy("batch").agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "SUPPORTED").alias("supported"), F.count_if(F.col("status") == "REJECTED").alias("rejected"), F.round(F.avg("confidence"), 4).alias("confidence"))
    share = F.col("supported") / F.col("claims")
    verdict = F.when((F.col("rejected") == 0) & (share >= 0.8), "PASS").when((F.col("rejected") <= 1) & (share >= 0.5), "PASS_WITH_WARNINGS").otherwise("REJECT")
    return by.withColumn("verdict", verdict)


def decision_rules(scored: DataFrame, forecast: DataFrame, anomalies: DataFrame, leaderboard: DataFrame) -> DataFrame:
    """``(category, title, risk, confidence, evidence)`` from reports: ``scored(overall_score)``, ``forecast(first, last)``, ``anomalies(total, high)``, ``leaderboard(model, score)``; a standing rule if no other applies."""
    rule = lambda df, category, title, risk, confidence, evidence: df.select(F.lit(category).alias("category"), title.alias("title"), risk.alias("risk"), F.lit(confidence).alias("confidence"), F.round(evidence, 4).alias("evidence"))
    way = F.when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing")
    change = F.abs((F.col("last") - F.col("first")) / (F.col("first") + 1e-9) * 100)
    top = leaderboard.orderBy(F.desc("score"), "model").limit(1)
    parts = [
        rule(scored.where("overall_score < 75"), "risk_mitigation", F.lit("validate_ingestion"), F.lit("LOW"), 0.95, F.col("overall_score")),
        rule(top, "model_deployment", F.concat(F.lit("deploy_"), F.col("model")), F.lit("MEDIUM"), 0.90, F.col("score")),
        rule(forecast, "operational", F.concat(F.lit("plan_for_"), way), F.lit("LOW"), 0.88, change),
        rule(anomalies.where("total > 0"), "risk_mitigation", F.lit("quarantine_anomalies"), F.when(F.col("high") > 0, "MEDIUM").otherwise("LOW"), 0.92, F.col("total").cast("double")),
    ]
    found = reduce(DataFrame.union, parts)
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("strategic"), F.lit("keep_monitoring"), F.lit("LOW"), F.lit(0.90), F.lit(None).cast("double"))
    return found.union(none)


def scatter_sample(df: DataFrame, x: str, y: str, key: str, k: int = 100) -> DataFrame:
    """``(key, x, y)``: the ``k`` points whose key has the least md5; a sampling operator."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(F.md5(F.col(key).cast("string")), key).limit(k).select(F.col(key), F.col(x).alias("x"), F.col(y).alias("y"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """``(severity, alerts)`` for all four severities."""
    labels = alerts.sparkSession.createDataFrame([(s,) for s in ("critical", "high", "medium", "low")], "severity string")
    return labels.join(alerts.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("alerts"))
