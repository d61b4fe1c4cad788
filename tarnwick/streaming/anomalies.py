"""Stream anomalies over the last values of each series: the batch form by windows, and a stateful stream of the same rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import numeric_columns
from ..functions.halo import STRETCH, Halo

OUTPUT = "series string, column string, ts timestamp, event_id long, value double, z double, anomaly_type string, severity string"


def records(df: DataFrame, series: str, ts: str, event: str, columns: list[str] | None = None) -> DataFrame:
    """``(series, column, ts, event_id, value)``: numeric columns below each other; NULL and NaN are left out."""
    columns = columns or [c for c in numeric_columns(df) if c not in (series, event)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.col(series).cast("string").alias("series"), F.col(ts).alias("ts"), F.col(event).cast("long").alias("event_id"), F.inline(pairs)).where("value is not null and not isnan(value)")


def severity(z: Column) -> Column:
    z = F.abs(z)
    return F.when(z >= 4, "critical").when(z >= 3, "high").when(z >= 2.5, "medium").otherwise("low")


def batch_anomalies(rows: DataFrame, window: int = 50, threshold: float = 2.8, factor: float = 2.5, stretch: int = STRETCH) -> DataFrame:
    """Anomalies of ``(series, column, ts, event_id, value)`` against the up to ``window`` values before each: z by the population deviation (1e-8 or less counts as 1), quartile fences (a distance of 1e-8 or less counts as 1); from max(10, window // 5) values on. z meets ``threshold`` by nine digits, so that the order of sums decides nothing. No task holds more than ``stretch`` rows of a series."""
    halo = Halo(rows, ["series", "column"], ["ts", "event_id"], window, 0, stretch)
    w = halo.window(-window, -1)
    q = lambda p: F.percentile("value", F.lit(p)).over(w)
    held = halo.rows.withColumns({"n": F.count("value").over(w), "m": F.avg("value").over(w), "s": F.stddev_pop("value").over(w), "a": q(0.25), "b": q(0.75)}).where("own_").where(F.col("n") >= max(10, window // 5))
    z = (F.col("value") - F.col("m")) / F.when(F.col("s") > 1e-8, F.col("s")).otherwise(1.0)
    wide = factor * F.when(F.col("b") - F.col("a") > 1e-8, F.col("b") - F.col("a")).otherwise(1.0)
    is_z, is_q = F.abs(F.round("z", 9)) >= threshold, (F.col("value") < F.col("a") - wide) | (F.col("value") > F.col("b") + wide)
    out = held.withColumn("z", z).withColumn("anomaly_type", F.when(is_z & is_q, "combined").when(is_z, "z_score").when(is_q, "iqr")).where("anomaly_type is not null")
    return out.select("series", "column", "ts", "event_id", "value", F.round("z", 4).alias("z"), "anomaly_type", severity(F.col("z")).alias("severity"))


#: Values scored at once, each against its own window.
SCORED = 10_000


def scan_values(values: list[float], buffer: list[float], window: int, threshold: float, factor: float) -> tuple[list[tuple[int, float, str]], list[float]]:
    """Anomalies (place, z, type) of new values in order against the buffer before each, and the buffer after them."""
    found = []
    series = np.concatenate([np.asarray(buffer, float), np.asarray(values, float)])
    first = len(buffer)
    # windows that are still filling have one length each, full ones the same: each length is scored at once
    at = max(first, max(10, window // 5))
    while at < len(series):
        size = min(at, window)
        end = min(at + SCORED, len(series)) if size == window else at + 1
        held = sliding_window_view(series[at - size : end - 1], size)
        # from the first value of a window on, so that large values that are equal have no deviation
        v, first_held = series[at:end], held[:, :1]
        far = held - first_held
        s = far.std(1)
        z = (v - first_held[:, 0] - far.mean(1)) / np.where(s > 1e-8, s, 1.0)
        a, b = np.percentile(held, [25, 75], axis=1)
        wide = factor * np.where(b - a > 1e-8, b - a, 1.0)
        by_z, by_q = np.abs(np.round(z, 9)) >= threshold, (v < a - wide) | (v > b + wide)
        kinds = np.select([by_z & by_q, by_z], ["combined", "z_score"], "iqr")
        found += [(int(at - first + i), round(float(z[i]), 4), str(kinds[i])) for i in np.flatnonzero(by_z | by_q)]
        at = end
    return found, series[-window:].tolist()


class _Scanner(StatefulProcessor):
    """Keeps the last values of a series and column in list state; a micro-batch is scored in the order (ts, event_id), ts in microseconds."""

    def __init__(self, window: int, threshold: float, factor: float):
        self.window, self.threshold, self.factor = window, threshold, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable", ignore_index=True)
        buffer = [x[0] for x in self.held.get()] if self.held.exists() else []
        found, buffer = scan_values(pdf["value"].tolist(), buffer, self.window, self.threshold, self.factor)
        self.held.put([(v,) for v in buffer])
        kept = pdf.loc[[i for i, _, _ in found], ["series", "column", "ts", "event_id", "value"]]
        # texts as plain objects: where Spark puts the frames of several groups together, others come in chunks
        out = kept.astype({"series": object, "column": object})
        out["z"] = [z for _, z, _ in found]
        out["anomaly_type"] = pd.Series([t for _, _, t in found], index=out.index, dtype=object)
        size = out["z"].abs()
        out["severity"] = np.select([size >= 4, size >= 3, size >= 2.5], ["critical", "high", "medium"], "low").astype(object)
        yield out

    def close(self) -> None:
        pass


def stream_anomalies(stream: DataFrame, window: int = 50, threshold: float = 2.8, factor: float = 2.5, late: str | None = "10 minutes") -> DataFrame:
    """The same rule over a stream of :func:`records`: repeated events within the watermark ``late`` are dropped, state is ``window`` numbers a series and column. With ``late`` None every row counts, as in :func:`batch_anomalies`, for sources that bring none twice. Needs the RocksDB state store."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series", "column", "event_id"]) if late else stream
    # ts as a number: pandas has local times, where an hour comes twice as summer time ends
    scored = once.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy("series", "column").transformWithStateInPandas(_Scanner(window, threshold, factor), OUTPUT.replace("ts timestamp", "ts long"), "Append", "None")
    return scored.withColumn("ts", F.timestamp_micros("ts"))


def stats(rows: DataFrame, anomalies: DataFrame, window: int = 50) -> DataFrame:
    """``(series, column, records, anomalies, rate, window_fill)``."""
    n = rows.groupBy("series", "column").agg(F.count("*").alias("records"))
    k = anomalies.groupBy("series", "column").agg(F.count("*").alias("k"))
    found = F.coalesce("k", F.lit(0))
    return n.join(k, ["series", "column"], "left").select("series", "column", "records", found.alias("anomalies"), F.round(found / F.col("records"), 4).alias("rate"), F.least(F.col("records"), F.lit(window)).alias("window_fill"))


def parquet_stream(spark, schema, path: str, files_at_once: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def numeric_stream(df: DataFrame, ts: str, most: int = 8) -> DataFrame:
    """``(ts, up to eight numeric columns as double)``; what isn't a number is 0."""
    return df.select(F.col(ts).alias("ts"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric_columns(df)[:most]])


def stream_index(stream: DataFrame, path: str, checkpoint: str, key: str, text: str, **trigger):
    """Index documents as they arrive: each micro-batch is a batch of the index under ``path``, so a document that comes again replaces what it was and a micro-batch that runs again changes nothing."""
    from ..operators.retrieval import index_documents

    def write(batch: DataFrame, batch_id: int) -> None:
        index_documents(batch, path, key, text, f"stream {batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
