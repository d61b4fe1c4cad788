"""Running sums over sorted values, and exact quantiles, without gathering all of a column's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], ranges: int = 64, few_keys: bool = True) -> DataFrame:
    """``df`` with ``<column>_upto`` for each of ``sums``: its sum over all rows of the ``keys`` with a value of ``order`` up to the row's own.

    ``order`` is numeric, not NULL and unique within the keys, as counts by value are. Approximate quantiles cut
    each key's values into ``ranges``; sums run within a range and start from those of the ranges before. The
    cuts are ``ranges`` numbers a key and are broadcast if the keys are few, as names of columns are; with
    ``few_keys`` false Spark decides by their size.
    """
    small = F.broadcast if few_keys else lambda d: d
    rows = df if keys else df.withColumn("key_", F.lit(0))
    by = keys or ["key_"]
    at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, at, F.lit(10 * ranges)).alias("cuts_"))
    ranged = rows.join(small(cuts), by).withColumn("range_", F.size(F.filter("cuts_", lambda c: c < F.col(order)))).drop("cuts_")
    totals = ranged.groupBy(*by, "range_").agg(*[F.sum(c).alias(f"{c}_all_") for c in sums])
    w = Window.partitionBy(*by).orderBy("range_")
    before = totals.select(*by, "range_", *[(F.sum(f"{c}_all_").over(w) - F.col(f"{c}_all_")).alias(f"{c}_before_") for c in sums])
    own = Window.partitionBy(*by, "range_").orderBy(order)
    run = ranged.withColumns({f"{c}_upto": F.sum(c).over(own) for c in sums}).join(small(before), [*by, "range_"])
    out = run.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"{c}_before_") for c in sums})
    return out.select(*df.columns, *[f"{c}_upto" for c in sums])


#: Accuracy of the approximate quantiles that exact ones start from.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], few_keys: bool = True) -> DataFrame:
    """``(keys, q array<double>)``: for each key the quantiles ``at`` of the non-NULL values, between two values by a straight line, as ``percentile`` gives them.

    Approximate quantiles a little below and above bracket each one; only the values within a bracket, some
    thousandths of all, are counted one by one, and their running sums tell the values of the wanted ranks. No
    task holds a column's values. A key without values has no row.
    """
    small = F.broadcast if few_keys else lambda d: d
    by = keys or ["key_"]
    rows = (df if keys else df.withColumn("key_", F.lit(0))).select(*by, F.col(value).cast("double").alias("v_")).where("v_ is not null")
    room = 2 / ACCURACY
    ends = lambda s: F.array(*[F.lit(min(1.0, max(0.0, p + s * room))) for p in at])
    brackets = rows.groupBy(*by).agg(F.percentile_approx("v_", ends(-1), F.lit(ACCURACY)).alias("low_"), F.percentile_approx("v_", ends(1), F.lit(ACCURACY)).alias("high_"))
    zone = lambda i: F.when(F.col("v_") < F.col("low_")[i], -1).when(F.col("v_") > F.col("high_")[i], 1).otherwise(0)
    spread = rows.join(small(brackets), by).select(*by, "v_", F.explode(F.array(*[F.struct(F.lit(i).alias("i_"), F.lit(p).alias("p_"), zone(i).alias("zone_")) for i, p in enumerate(at)])).alias("z_")).select(*by, "v_", "z_.*")
    zoned = cut(spread.groupBy(*by, "i_", "p_", "zone_", F.when(F.col("zone_") == 0, F.col("v_")).alias("inside_")).agg(F.count("*").alias("n_"), F.min("v_").alias("least_"), F.max("v_").alias("most_")))
    own = [*by, "i_"]
    totals = zoned.groupBy(*own, "p_").agg(F.sum("n_").alias("all_"), F.coalesce(F.sum(F.when(F.col("zone_") == -1, F.col("n_"))), F.lit(0)).alias("below_"), F.coalesce(F.sum(F.when(F.col("zone_") == 1, F.col("n_"))), F.lit(0)).alias("above_"), F.max(F.when(F.col("zone_") == -1, F.col("most_"))).alias("before_"), F.min(F.when(F.col("zone_") == 1, F.col("least_"))).alias("after_"))
    within = running_sums(zoned.where("zone_ = 0").select(*own, "inside_", "n_"), own, "inside_", ["n_"], 16, few_keys).join(small(totals), own)
    wanted = F.col("p_") * (F.col("all_") - 1)
    value_at = lambda rank: F.max(F.when((rank >= F.col("below_") + F.col("n__upto") - F.col("n_")) & (rank < F.col("below_") + F.col("n__upto")), F.col("inside_")))
    ranked = within.groupBy(*own, "p_", "all_", "below_", "above_", "before_", "after_").agg(value_at(F.floor(wanted)).alias("x_"), value_at(F.ceil(wanted)).alias("y_"))
    pick = lambda rank, c: F.when(rank < F.col("below_"), F.col("before_")).when(rank >= F.col("all_") - F.col("above_"), F.col("after_")).otherwise(F.col(c))
    x, y = pick(F.floor(wanted), "x_"), pick(F.ceil(wanted), "y_")
    out = ranked.select(*own, (x + (y - x) * (wanted - F.floor(wanted))).alias("q_"))
    return out.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "q_"))), lambda e: e["q_"]).alias("q")).select(*keys, "q")
