"""Sinks: reports that replace those of a data set, alerts of a stream, graphs by project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_report(report: DataFrame, path: str, dataset_id: str) -> None:
    """Replace the report of ``dataset_id``; those of other data sets stay."""
    report.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, **trigger):
    """Start writing a stream of alerts as Parquet; returns the query."""
    return alerts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write nodes and edges by project; those of the projects in hand are replaced."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, from Parquet or from a JSON file ``{nodes: [...], edges: [...]}``."""
    if path.endswith(".json"):
        whole = spark.read.option("multiLine", True).json(path)
        return tuple(whole.select(F.explode(part).alias("r")).select("r.*") for part in ("nodes", "edges"))
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
