"""Cutting lineage by reliable checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a cluster it is an error, since executors could not see a folder of the driver's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and read it back from a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Most rows of a table that is sent to all tasks.
FEW = 100_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` computed now, and sent to all tasks in a join if it has at most ``most`` rows, so that a large other side is not shuffled. Of more rows a join hashes the part of a task, so that the other side is shuffled, but not sorted."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= most else done.hint("shuffle_hash")


#: Rows of a part, where what a task holds goes by its rows.
PART = 500_000


def even(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over so many parts for ``rows`` rows that a task's share does not grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART)), *keys)
