"""Windows over long series without a task that holds a series.

Rows are sorted once by range, numbered within their series, and dealt to stretches of so many numbers; a row
near the end of its stretch is also a guest of the next one, for as many rows as a window reaches. A window
over (series, stretch) then sees all it needs, whatever share of the rows one series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .lineage import cut

#: Rows of one series in a stretch.
STRETCH = 10_000


def numbered(df: DataFrame, keys: list[str], order: list[str], to: str = "place_") -> DataFrame:
    """``df`` with each row's number within its keys, from 0, in the order of ``order``; nulls come first, rows that tie in any order."""
    at = F.monotonically_increasing_id()
    # ids go up with the ranges, and with the rows within each
    rows = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("id_", at))
    rows = rows.withColumn("range_", F.shiftright("id_", 33))
    same = [F.col(k).eqNullSafe(F.col(f"k{i}_")) for i, k in enumerate(keys)]
    ranges = rows.groupBy("range_", *keys).agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    w = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("first_", F.col("first_") - F.coalesce(F.sum("n_").over(w), F.lit(0)))
    before = before.select(F.col("range_").alias("r_"), *[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], "first_")
    joined = rows.join(before, [rows["range_"] == before["r_"], *same])
    return joined.withColumn(to, F.col("id_") - F.col("first_")).select(*df.columns, to)


class Halo:
    """``rows``: those of ``df`` with ``place_``, ``stretch_`` and ``own_``, guests among them. Windows by :meth:`window` reach up to ``before`` rows back and ``after`` ahead; :meth:`own` leaves the guests out."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], before: int, after: int, stretch: int = STRETCH):
        self.keys, self.columns = keys, df.columns
        size = max(stretch, before, after, 1)
        home = F.floor(F.col("place_") / size).cast("long")
        within = F.col("place_") - home * size
        none = F.array().cast("array<bigint>")
        homes = F.concat(F.array(home), F.when(within >= size - before, F.array(home + 1)).otherwise(none) if before else none, F.when((within < after) & (home > 0), F.array(home - 1)).otherwise(none) if after else none)
        dealt = numbered(df, keys, order).select("*", home.alias("home_"), F.explode(homes).alias("stretch_")).withColumn("own_", F.col("home_") == F.col("stretch_")).drop("home_")
        # windows cost time, not bytes: by a number of partitions that is not lowered to few large ones
        self.rows = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "stretch_")

    def window(self, first: int, last: int) -> WindowSpec:
        return Window.partitionBy(*self.keys, "stretch_").orderBy("place_").rowsBetween(first, last)

    def own(self, rows: DataFrame, *columns: str | Column) -> DataFrame:
        """The rows that are no guests: the columns of the frame that went in, and ``columns``."""
        return rows.where("own_").select(*self.columns, *columns)

    def next_known(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` without guests, where ``columns`` that are null take the next value that is not, in their own stretch or one after it. The first of ``columns`` tells whether all are known."""
        rows = rows.where("own_")
        value = F.struct(*columns)
        known = F.when(F.col(columns[0]).isNotNull(), value)
        back = Window.partitionBy(*self.keys, "stretch_").orderBy(F.desc("place_")).rowsBetween(Window.unboundedPreceding, 0)
        first = rows.groupBy(*self.keys, "stretch_").agg(F.min_by(value, F.when(F.col(columns[0]).isNotNull(), F.col("place_"))).alias("first_"))
        first = first.withColumn("first_", F.when(F.col(f"first_.{columns[0]}").isNotNull(), F.col("first_")))
        later = Window.partitionBy(*self.keys).orderBy(F.desc("stretch_")).rowsBetween(Window.unboundedPreceding, -1)
        names = {k: f"k{i}_" for i, k in enumerate(self.keys)}
        carried = first.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("stretch_").alias("next_stretch_"), F.last("first_", True).over(later).alias("carried_"))
        filled = rows.withColumn("near_", F.last(known, True).over(back))
        out = filled.join(carried, [*[F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.col("stretch_") == F.col("next_stretch_")], "left")
        got = F.coalesce("near_", "carried_")
        return out.withColumns({c: got[c] for c in columns}).drop("near_", "carried_", "next_stretch_", *names.values())
