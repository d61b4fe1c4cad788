"""A model registry as append-only tables: versions, stage events, comparison and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STAGES = ("development", "staging", "production", "archived")
#: Name parts of metrics that are better when lower.
LOWER_BETTER = "mae|mse|rmse|loss|error"


def register(events: DataFrame) -> DataFrame:
    """Versions of rows ``(model_id, created_at, version_id, ...)``: adds ``version_tag`` (v1, v2, ... per model by time, then id) and ``parent_id``, the version before."""
    w = Window.partitionBy("model_id").orderBy("created_at", "version_id")
    return events.withColumns({"version_tag": F.concat(F.lit("v"), F.row_number().over(w).cast("string")), "parent_id": F.lag("version_id").over(w)})


def versions(registry: DataFrame, model_id: str | None = None, version_id: str | None = None) -> DataFrame:
    if model_id is not None:
        registry = registry.where(F.col("model_id") == model_id)
    return registry if version_id is None else registry.where(F.col("version_id") == version_id)


def compare(registry: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, metric, value_a, value_b, delta, winner)`` for ``pairs(a, b)`` of version ids; ``metrics`` is a map. Where a side lacks the metric, delta and winner are NULL; equal values tie."""
    m = registry.select("version_id", F.explode("metrics").alias("metric", "value"))
    left = pairs.join(m.withColumnsRenamed({"version_id": "a", "value": "value_a"}), "a")
    right = pairs.join(m.withColumnsRenamed({"version_id": "b", "value": "value_b"}), "b")
    both = left.join(right, ["a", "b", "metric"], "full_outer")
    d = F.round(F.col("value_b") - F.col("value_a"), 6)
    better_b = F.when(F.col("metric").rlike(f"(?i){LOWER_BETTER}"), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return both.withColumn("delta", d).withColumn("winner", F.when(F.col("delta") == 0, "tie").when(better_b, "b").when(F.col("delta").isNotNull(), "a")).select("a", "b", "metric", "value_a", "value_b", "delta", "winner")


def winners(compared: DataFrame) -> DataFrame:
    """``(a, b, wins_a, wins_b, winner)``: the majority of the metrics."""
    by = compared.groupBy("a", "b").agg(F.count_if(F.col("winner") == "a").alias("wins_a"), F.count_if(F.col("winner") == "b").alias("wins_b"))
    return by.withColumn("winner", F.when(F.col("wins_b") > F.col("wins_a"), "b").when(F.col("wins_a") > F.col("wins_b"), "a").otherwise("tie"))


def promote(registry: DataFrame, events: DataFrame) -> DataFrame:
    """Versions with ``stage``: that of the latest of ``events(version_id, stage, at)`` with a valid stage, else development."""
    last = events.where(F.col("stage").isin(*STAGES)).groupBy("version_id").agg(F.max_by("stage", F.struct("at", "stage")).alias("stage"))
    return registry.drop("stage").join(last, "version_id", "left").withColumn("stage", F.coalesce("stage", F.lit(STAGES[0])))


def lineage(registry: DataFrame, most: int = 50) -> DataFrame:
    """``(version_id, depth, ancestor)``: each version's chain of parents, itself at depth 0, up to ``most`` steps; a cycle ends where it would repeat."""
    parents = registry.select(F.col("version_id").alias("v_"), "parent_id").where("parent_id is not null")
    step = registry.select("version_id", F.lit(0).alias("depth"), F.col("version_id").alias("ancestor"), F.array("version_id").alias("path"))
    out = step
    for _ in range(most):
        step = step.join(parents, F.col("ancestor") == F.col("v_")).where(~F.array_contains("path", F.col("parent_id"))).select("version_id", (F.col("depth") + 1).alias("depth"), F.col("parent_id").alias("ancestor"), F.concat("path", F.array("parent_id")).alias("path"))
        if step.isEmpty():
            break
        out = out.union(step)
    return out.select("version_id", "depth", "ancestor")
