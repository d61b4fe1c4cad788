"""What Spark's file systems tell about folders, wherever they are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none where there is no such folder."""
    files, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at) if x.isDirectory()) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def make(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.mkdirs(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    files, at = _at(spark, path)
    if not files.rename(at, _at(spark, to)[1]):
        raise OSError(f"{path} was not moved to {to}")


def parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the files of one write, in the order of their partitions."""
    files, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at) if x.getPath().getName().startswith("part-"))


def in_order(spark: SparkSession, path: str) -> None:
    """Gives the files of one write times of change a second apart, in the order of their partitions, up to that of the last."""
    files, at = _at(spark, path)
    found = sorted((x for x in files.listStatus(at) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())
    last = max((x.getModificationTime() for x in found), default=0)
    for i, x in enumerate(found):
        files.setTimes(x.getPath(), last - 1000 * (len(found) - 1 - i), -1)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files beneath a folder."""
    files, at = _at(spark, path)
    return files.getContentSummary(at).getLength()
