"""Density clusters by cells whose diagonal is the radius: what lies in one cell is near, so only cells are linked, never all pairs of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut
from .graph import components

#: Points of two boxes are compared one by one up to this many pairs; larger boxes are halved.
FEW = 4096
#: A cell with more than one in so many of all points is hot, and its points are spread over tasks.
HOT = 1000


def _box(t: str, level: int) -> Column:
    """The box of side 2^-level that holds a point."""
    return F.transform(t, lambda v: F.floor(v * float(2**level)))


def _between(a: str, b: str, level: int, more: int) -> Column:
    """Squared distance of two boxes: the least with ``more`` -1, the greatest with 1."""
    steps = F.zip_with(a, b, lambda u, v: F.greatest(F.abs(u - v) + more, F.lit(0)) / float(2**level))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v * v)


def _apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def _close_cells(cells: DataFrame, reach: int, far: float) -> DataFrame:
    """``(a, b)``: cells that may hold points within the radius of each other, each with itself too. They meet in squares of ``reach`` cells over the first two columns."""
    width = len(cells.first()["cell"])
    names = [f"g{d}" for d in range(min(2, width))]
    squares = [F.floor(F.col("cell")[d] / reach).alias(n) for d, n in enumerate(names)]
    left = cells.select(F.col("cell").alias("a"), *squares)
    right = cells.select(F.col("cell").alias("b"), *squares)
    for n in names:
        right = right.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    return left.join(right, names).where(_between("a", "b", 0, -1) <= far).select("a", "b")


def _near(asked: DataFrame, close: DataFrame, points: DataFrame, hot: DataFrame, eps: float) -> DataFrame:
    """``(i, j)``: each asked point ``(i, x, cell)`` with the ``points`` within ``eps``. Asked points come from cells of few points, so
    few meet in a cell; the points of a hot cell lie in as many parts as ``hot(cell, parts)`` says, each with the asked points beside it."""
    parts = lambda df: df.join(F.broadcast(hot), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    beside = asked.join(close, F.col("cell") == F.col("a")).select("i", "x", F.col("b").alias("cell"))
    beside = parts(beside).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    spread = parts(points.select(F.col("i").alias("j"), F.col("x").alias("y"), "cell")).withColumn("part", F.pmod(F.xxhash64("j"), F.col("parts")).cast("int")).drop("parts")
    return beside.join(spread, ["cell", "part"]).where(_apart("x", "y") <= eps * eps).select("i", "j")


def _links(cores: DataFrame, close: DataFrame, eps: float, far: float) -> DataFrame:
    """``(a, b)``: cells with core points within ``eps`` of each other. Boxes that are near as a whole link their cells at once; those
    that may be near are halved while they hold many points, and points are compared one by one once they hold few. Points that are
    equal count once, so halving ends."""
    spots = cut(cores.select("cell", "x", "t").distinct())
    own = spots.select("cell").distinct()
    open_ = close.where(F.col("a") < F.col("b")).join(own.withColumnRenamed("cell", "a"), "a", "left_semi").join(own.withColumnRenamed("cell", "b"), "b", "left_semi").select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"))
    linked = None
    level = 0
    while True:
        counts = spots.groupBy("cell", _box("t", level).alias("box")).agg(F.count("*").alias("n"))
        end = lambda cell, box, n: counts.select(F.col("cell").alias(cell), F.col("box").alias(box), F.col("n").alias(n))
        sized = cut(open_.join(end("a", "u", "n_u"), ["a", "u"]).join(end("b", "v", "n_v"), ["b", "v"]))
        few = sized.where(F.col("n_u") * F.col("n_v") <= FEW)
        at = lambda cell, box, x: spots.select(F.col("cell").alias(cell), _box("t", level).alias(box), F.col("x").alias(x))
        met = few.join(at("a", "u", "x"), ["a", "u"]).join(at("b", "v", "y"), ["b", "v"]).where(_apart("x", "y") <= eps * eps).select("a", "b").distinct()
        linked = cut(met if linked is None else linked.union(met))
        many = sized.where(F.col("n_u") * F.col("n_v") > FEW).join(linked, ["a", "b"], "left_anti")
        halves = lambda cell, box, child: spots.select(F.col("cell").alias(cell), _box("t", level).alias(box), _box("t", level + 1).alias(child)).distinct()
        finer = many.select("a", "b", "u", "v").join(halves("a", "u", "c"), ["a", "u"]).join(halves("b", "v", "d"), ["b", "v"]).select("a", "b", F.col("c").alias("u"), F.col("d").alias("v"))
        level += 1
        finer = cut(finer.where(_between("u", "v", level, -1) <= far))
        whole = finer.where(_between("u", "v", level, 1) <= far * (1 - 1e-6)).select("a", "b").distinct()
        linked = cut(linked.union(whole))
        open_ = cut(finer.join(linked, ["a", "b"], "left_anti").select("a", "b", "u", "v"))
        if open_.isEmpty():
            return linked.distinct()


def clusters(df: DataFrame, key: str, columns: list[str], eps: float, least: int) -> DataFrame:
    """``(key, cluster)`` as ``ml.dbscan`` says.

    Cells have a side of ``eps`` / sqrt(columns), so a cell of ``least`` points has only core points and is one cluster. Points of
    smaller cells are counted against the points around them: fewer than ``least`` a cell, so work is linear in the points, however
    many lie in one cell. Clusters are the components of the cells with core points.
    """
    side = eps / math.sqrt(len(columns)) * (1 - 1e-6)
    far = (eps / side) ** 2 * (1 + 1e-9)
    reach = math.floor(eps / side) + 1
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    keys = df.select(F.col(f"`{key}`").cast("string").alias("i"), x.alias("x"))
    points = cut(keys.where(F.forall("x", finite)).withColumn("t", F.transform("x", lambda v: v / side)).withColumn("cell", _box("t", 0)))
    cells = cut(points.groupBy("cell").agg(F.count("*").alias("n")))
    total = cells.agg(F.sum("n")).first()[0]
    if total is None:
        return keys.select(F.col("i").alias(key), F.lit("-1").alias("cluster"))
    close = cut(_close_cells(cells, reach, far))
    # fewer than HOT rows
    hot = cells.where(F.col("n") * HOT > total).select("cell", F.least(F.lit(HOT), F.ceil(F.col("n") * HOT / total)).cast("int").alias("parts"))
    own = points.join(cells.where(F.col("n") < least), "cell", "left_semi")
    counted = _near(own, close, points, hot, eps).groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("i")
    cores = cut(points.join(cells.where(F.col("n") < least), "cell", "left_anti").unionByName(own.join(counted, "i", "left_semi")))
    named = cores.groupBy("cell").agg(F.min("i").alias("id"))
    ends = lambda c: named.select(F.col("cell").alias(c), F.col("id").alias(f"{c}_id"))
    edges = _links(cores, close, eps, far).join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"))
    held = named.join(components(named.select("id"), edges), "id").select("cell", "component")
    inside = cores.join(held, "cell").select("i", "component")
    loose = own.join(counted, "i", "left_anti")
    touched = _near(loose, close, cores, hot, eps).groupBy("i").agg(F.min("j").alias("j"))
    border = touched.join(inside.withColumnRenamed("i", "j"), "j").select("i", "component")
    found = inside.union(border)
    return keys.select("i").join(found, "i", "left").select(F.col("i").alias(key), F.coalesce("component", F.lit("-1")).alias("cluster"))
