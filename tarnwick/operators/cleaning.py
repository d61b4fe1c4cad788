"""Cleaning: gaps, imputation, duplicates, fences; filters and set operations over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.halo import Halo
from ..functions.ranges import exact_quantiles
from .profile import long_numeric


def _quantile_row(df: DataFrame, columns: list[str], at: list[float]) -> DataFrame:
    """One row with an array of quantiles for each of ``columns``, NULL for a column without values."""
    q = exact_quantiles(long_numeric(df, columns), ["column"], "value", at)
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in columns])


def fill_order_gaps(df: DataFrame, column: str, keys: list[str], order: list[str], default: float = 0.0) -> DataFrame:
    """Fill NULLs along ``order`` within ``keys``: from the next value, else the last one, else ``default``. No task holds a series."""
    halo = Halo(df, keys, order, 0, 0)
    # where no value follows, the last one before a row is the last of its keys
    last = halo.rows.groupBy(*[F.col(k).alias(f"l{i}_") for i, k in enumerate(keys)]).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("place_"))).alias("last_"))
    filled = halo.next_known(halo.rows, [column]).join(last, [F.col(k).eqNullSafe(F.col(f"l{i}_")) for i, k in enumerate(keys)], "left")
    return filled.withColumn(column, F.coalesce(column, "last_", F.lit(default))).select(*df.columns)


def impute(df: DataFrame, columns: list[str], how: str = "median", constant: object = None) -> DataFrame:
    """Fill NULLs by the exact median, the mode (the least of equal ones) or a constant."""
    if how == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(constant)) for c in columns})
    if how == "median":
        stats = _quantile_row(df, columns, [0.5]).select(*[F.col(c)[0].alias(f"{c}_fill_") for c in columns])
    else:
        stats = df.agg(*[F.mode(c, True).alias(f"{c}_fill_") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[F.coalesce(F.col(c), F.col(f"{c}_fill_")).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_recommended(df: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Drop the columns whose recommended action is DROP_COLUMN; the report has a row for a column at most a few times."""
    names = [r["column"] for r in recommendations.where("action = 'DROP_COLUMN'").select("column").distinct().collect()]
    return df.drop(*names)


def deduplicate(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """One row: ``<column>_low`` and ``<column>_high``, the quartiles less and plus ``factor`` times their distance."""
    q = _quantile_row(df, columns, [0.25, 0.75])
    wide = lambda c: (F.col(c)[1] - F.col(c)[0]) * factor
    return q.select(*[x for c in columns for x in ((F.col(c)[0] - wide(c)).alias(f"{c}_low"), (F.col(c)[1] + wide(c)).alias(f"{c}_high"))])


def winsorize(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """Clip to the fences; NULL stays NULL."""
    out = df.crossJoin(F.broadcast(fences(df, columns, factor)))
    clip = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}_low")), F.col(f"{c}_high"))).alias(c)
    return out.select(*[clip(c) if c in columns else F.col(c) for c in df.columns])


def metadata_filter(df: DataFrame, filters: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose map has every one of ``filters``."""
    for k, v in filters.items():
        df = df.where(F.col(column)[k] == v)
    return df


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def owned(child: DataFrame, parent: DataFrame, key: str, owner: Column, newest: str) -> DataFrame:
    """Rows of ``child`` whose parent fulfils ``owner``, newest first."""
    return child.join(parent.where(owner), key).orderBy(F.desc(newest), *child.columns[:1])


def document_delete(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """An index table without the rows of the documents to delete."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` (a total order), with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
