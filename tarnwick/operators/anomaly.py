"""Anomalies in batch: statistics, residuals, change points, forests, neighbours, reconstruction, limits and their consensus.

Detectors add ``<name>_score`` (0 to 1) and ``<name>_flag``. Whole-series statistics are aggregates joined
back, never windows without a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.halo import STRETCH, Halo
from ..functions.lineage import cut
from ..functions.ranges import exact_quantiles

#: Normal range and critical bound of sensors by name; voltage is critical below its bound.
SENSORS = {"temperature": (50.0, 80.0, 95.0), "voltage": (210.0, 245.0, 190.0), "vibration": (0.0, 0.08, 0.12), "pressure": (25.0, 35.0, 42.0), "current": (8.0, 16.0, 20.0)}


def _clip(c: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4)


def _stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(*aggs), keys)


def _quantiles(df: DataFrame, keys: list[str], y: str, at: list[float], to: str) -> DataFrame:
    """``df`` with the quantiles of ``y`` within its key as ``to``."""
    return df.join(exact_quantiles(df, keys, y, at, few_keys=False).withColumnRenamed("q", to), keys, "left")


def zscore(df: DataFrame, keys: list[str], y: str, threshold: float = 3.0) -> DataFrame:
    """Adds ``z``, ``zscore_score``, ``zscore_flag``; a deviation of 0 gives z 0."""
    rows = _stats(df, keys, F.avg(y).alias("m_"), F.stddev_samp(y).alias("s_"))
    z = F.coalesce(F.when(F.col("s_") > 0, (F.col(y) - F.col("m_")) / F.col("s_")), F.lit(0.0))
    return rows.withColumn("z", F.round(z, 4)).withColumns({"zscore_score": _clip(F.abs(z) / (2 * threshold)), "zscore_flag": F.abs(z) > threshold}).drop("m_", "s_")


def modified_zscore(df: DataFrame, keys: list[str], y: str, threshold: float = 3.5, quartiles: str | None = None) -> DataFrame:
    """Adds ``mad_z``, ``mad_score``, ``mad_flag`` by the median absolute deviation; one of 0 gives 0. ``quartiles`` may name a column that holds the three of ``y``."""
    rows = df.withColumn("m_", F.col(quartiles)[1]) if quartiles else _quantiles(df, keys, y, [0.5], "m_").withColumn("m_", F.col("m_")[0])
    rows = _quantiles(rows.withColumn("off_", F.abs(F.col(y) - F.col("m_"))), keys, "off_", [0.5], "d_").withColumn("d_", F.col("d_")[0]).drop("off_")
    z = F.coalesce(F.when(F.col("d_") > 0, 0.6745 * (F.col(y) - F.col("m_")) / F.col("d_")), F.lit(0.0))
    return rows.withColumn("mad_z", F.round(z, 4)).withColumns({"mad_score": _clip(F.abs(z) / (2 * threshold)), "mad_flag": F.abs(z) > threshold}).drop("m_", "d_")


def iqr(df: DataFrame, keys: list[str], y: str, factor: float = 1.5, quartiles: str | None = None) -> DataFrame:
    """Adds ``iqr_score`` (distance from the fence over the quartile distance) and ``iqr_flag``. ``quartiles`` may name a column that holds the three of ``y``."""
    rows = df.withColumn("q_", F.col(quartiles)) if quartiles else _quantiles(df, keys, y, [0.25, 0.5, 0.75], "q_")
    a, b = F.col("q_")[0], F.col("q_")[2]
    low, high = a - factor * (b - a), b + factor * (b - a)
    far = F.greatest(low - F.col(y), F.col(y) - high, F.lit(0.0))
    return rows.withColumns({"iqr_score": _clip(far / (b - a + 1e-6)), "iqr_flag": F.coalesce(far > 0, F.lit(False))}).drop("q_")


def rolling_zscore(df: DataFrame, keys: list[str], ts: str, y: str, window: int = 14, threshold: float = 2.8, stretch: int = STRETCH) -> DataFrame:
    """Adds ``rolling_score``, ``rolling_flag``: against the ``window`` rows up to the row itself, from 3 values on; rows with fewer take the next statistics there are. No task holds more than ``stretch`` rows of a series."""
    halo = Halo(df, keys, [ts], window - 1, 0, stretch)
    w = halo.window(1 - window, 0)
    full = F.count(y).over(w) >= 3
    rows = halo.rows.withColumns({"m_": F.when(full, F.avg(y).over(w)), "s_": F.when(full, F.stddev_samp(y).over(w))})
    rows = halo.next_known(rows, ["m_", "s_"])
    z = F.coalesce(F.abs(F.col(y) - F.col("m_")) / F.when(F.col("s_") > 0, F.col("s_")).otherwise(1e-6), F.lit(0.0))
    return halo.own(rows, _clip(z / (2 * threshold)).alias("rolling_score"), (z > threshold).alias("rolling_flag"))


def residuals(df: DataFrame, keys: list[str], ts: str, y: str, expected: str | None = None, window: int = 14, threshold: float = 3.0, stretch: int = STRETCH) -> DataFrame:
    """Adds ``expected``, ``residual``, ``residual_score``, ``residual_flag``: expected is a column, or the median of the 7 rows before to the 6 after (3 at least). No task holds more than ``stretch`` rows of a series."""
    back, ahead = window // 2, window - window // 2 - 1
    halo = Halo(df, keys, [ts], window - 1 + (0 if expected else back), 0 if expected else ahead, stretch)
    w = halo.window(-back, ahead)
    usual = F.col(expected) if expected else F.when(F.count(y).over(w) >= 3, F.percentile(y, F.lit(0.5)).over(w)).otherwise(F.col(y))
    rows = halo.rows.withColumn("e_", usual).withColumn("r_", F.col(y) - F.col("e_"))
    t = halo.window(1 - window, 0)
    sd = F.when(F.count("r_").over(t) >= 3, F.stddev_samp("r_").over(t))
    rows = rows.withColumn("z_", F.coalesce(F.abs("r_") / F.when(sd > 1e-6, sd), F.lit(0.0)))
    out = halo.own(rows, "e_", "r_", "z_")
    return out.withColumns({"expected": F.round("e_", 4), "residual": F.round("r_", 4), "residual_score": _clip(F.col("z_") / (2 * threshold)), "residual_flag": F.col("z_") > threshold}).drop("e_", "r_", "z_")


def change_points(df: DataFrame, keys: list[str], ts: str, y: str, w: int = 7, least: float = 2.5, stretch: int = STRETCH) -> DataFrame:
    """``(keys, ts, t, magnitude, pct_change, direction, confidence)``: where the means of ``w`` rows before and from the row on differ by a t of ``least`` or more, the highest within w // 2 rows."""
    halo = Halo(df.select(*keys, ts, y), keys, [ts], w + w // 2, w - 1 + w // 2, stretch)
    before, after = halo.window(-w, -1), halo.window(0, w - 1)
    rows = halo.rows.withColumns({"nb": F.count(y).over(before), "na": F.count(y).over(after), "mb": F.avg(y).over(before), "ma": F.avg(y).over(after), "vb": F.var_samp(y).over(before), "va": F.var_samp(y).over(after)})
    t = F.abs(F.col("ma") - F.col("mb")) / F.sqrt(F.col("vb") / w + F.col("va") / w + 1e-8)
    rows = rows.withColumn("t", F.when((F.col("nb") == w) & (F.col("na") == w), t))
    rows = rows.withColumn("top", F.max("t").over(halo.window(-(w // 2), w // 2))).where("own_").where((F.col("t") >= least) & (F.col("t") == F.col("top")))
    d = F.col("ma") - F.col("mb")
    return rows.select(*keys, ts, F.round("t", 4).alias("t"), F.round(F.abs(d), 4).alias("magnitude"), F.round(100 * d / (F.abs("mb") + 1e-6), 2).alias("pct_change"), F.when(d > 0, "UP").otherwise("DOWN").alias("direction"), F.round(F.least(F.lit(1.0), F.col("t") / 5), 4).alias("confidence"))


def _grow(x: np.ndarray, random: np.random.Generator, depth: int, most: int, nodes: list) -> int:
    """Add the nodes of an isolation tree as (column or -1, cut, left, right, path length); returns the root's place."""
    n = len(x)
    spread = np.flatnonzero(x.max(0) > x.min(0)) if n > 1 else []
    if depth >= most or not len(spread):
        extra = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0
        nodes.append((-1, 0.0, -1, -1, depth + extra))
        return len(nodes) - 1
    c = int(random.choice(spread))
    edge = float(random.uniform(x[:, c].min(), x[:, c].max()))
    at = len(nodes)
    nodes.append(None)
    low = x[:, c] < edge
    left, right = _grow(x[low], random, depth + 1, most, nodes), _grow(x[~low], random, depth + 1, most, nodes)
    nodes[at] = (c, edge, left, right, 0.0)
    return at


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``isolation_score`` (0 to 1, least to most isolated) and ``isolation_flag`` for the most isolated share.

    Each tree grows on about ``sample`` rows chosen by a hash of ``key``: a bounded sample a tree, trees side by side; the trees are small and sent to the tasks, which score all rows. NULLs count as 0.
    """
    rows = df.select(F.col(key), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    n = rows.count()
    level = lambda t: F.pmod(F.xxhash64(F.col(key), t), F.lit(1 << 40)) / (1 << 40)
    each = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: level(t) < min(1.0, sample / max(n, 1)))))

    def grow(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes: list = []
        x = np.stack(pdf.sort_values("k", kind="stable")["x"].to_numpy())
        _grow(x, np.random.default_rng(seed + int(key_[0])), 0, int(np.ceil(np.log2(max(len(x), 2)))), nodes)
        a, b, c, d, e = zip(*nodes)
        return pd.DataFrame({"tree": [key_[0]], "c": [list(a)], "cut": [list(b)], "l": [list(c)], "r": [list(d)], "depth": [list(e)]})

    grown = each.select("tree", F.col(key).alias("k"), "x").groupBy("tree").applyInPandas(grow, "tree int, c array<int>, cut array<double>, l array<int>, r array<int>, depth array<double>").orderBy("tree").collect()
    forest = [tuple(np.array(t[f]) for f in ("c", "cut", "l", "r", "depth")) for t in grown]
    size = min(sample, max(n, 2))
    usual = 2 * (np.log(max(size - 1, 1)) + 0.5772156649) - 2 * (size - 1) / size

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(columns)))
        total = np.zeros(len(m))
        for c, edge, left, right, depth in forest:
            at = np.zeros(len(m), np.int64)
            while (go := c[at] >= 0).any():
                i = np.flatnonzero(go)
                k = at[i]
                at[i] = np.where(m[i, c[k]] < edge[k], left[k], right[k])
            total += depth[at]
        return pd.Series(2.0 ** -(total / max(len(forest), 1) / max(usual, 1e-9)))

    raw = cut(df.withColumn("raw_", score(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))))  # scored once for bounds and rows
    top = exact_quantiles(raw, [], "raw_", [1 - contamination]).select(F.col("q")[0].alias("p_"))
    span = raw.agg(F.min("raw_").alias("a_"), F.max("raw_").alias("b_")).crossJoin(F.broadcast(top))
    out = raw.crossJoin(F.broadcast(span))
    return out.withColumns({"isolation_score": _clip((F.col("raw_") - F.col("a_")) / F.when(F.col("b_") > F.col("a_"), F.col("b_") - F.col("a_")).otherwise(1.0)), "isolation_flag": F.col("raw_") > F.col("p_")}).drop("raw_", "a_", "b_", "p_")


#: Rows of a tile of points on average, and tiles of a strip when boxes are compared.
TILE, STRIP = 1024, 64


def _least_k(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int, step: int = 256):
    """For each point (i, x) its ``k`` nearest of the points (j, y) but itself, ties by j: places in i, places in j, distances to nine decimals."""
    order = np.argsort(j, kind="stable")
    j, y = j[order], y[order]
    for a in range(0, len(x), step):
        d = np.round(np.sqrt(((x[a : a + step, None, :] - y[None, :, :]) ** 2).sum(2)), 9)
        d[i[a : a + step, None] == j[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        far = np.take_along_axis(d, best, 1)
        row, col = np.nonzero(np.isfinite(far))
        yield row + a, order[best[row, col]], far[row, col]


def nearest(points: DataFrame, dims: int, k: int) -> DataFrame:
    """``(i, j, d)``: the ``k`` nearest others of each of ``points(i, x)``, ties by ``j``, over all points; ``i`` is a unique long, ``x`` has ``dims`` numbers.

    Points are dealt to tiles of bounded size, side by side in the first two dimensions. The nearest in its own
    tile bound how far a point has to look; it then meets only the tiles whose boxes reach into that distance.
    """
    points = cut(points)
    n = points.count()
    slabs = max(1, int(np.ceil(np.sqrt(n / TILE))))
    at = F.array(*[F.lit(q / slabs) for q in range(1, slabs)]) if slabs > 1 else None
    place = lambda c, x: F.size(F.filter(c, lambda e: e < x))
    rows = points.withColumn("s", F.lit(0)).withColumn("p", F.lit(0))
    if slabs > 1:
        first = points.agg(F.percentile_approx(F.col("x")[0], at, F.lit(1000)).alias("c"))
        rows = points.crossJoin(F.broadcast(first)).withColumn("s", place("c", F.col("x")[0])).drop("c").withColumn("p", F.lit(0))
        if dims > 1:
            second = rows.groupBy("s").agg(F.percentile_approx(F.col("x")[1], at, F.lit(1000)).alias("c"))
            rows = rows.join(F.broadcast(second), "s").withColumn("p", place("c", F.col("x")[1])).drop("c")
    sizes = rows.groupBy("s", "p").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / (4 * TILE)).cast("int")
    rows = cut(rows.join(sizes, ["s", "p"]).withColumn("t", F.concat_ws("_", "s", "p", F.pmod(F.xxhash64("i"), parts))).select("i", "x", "t"))

    def own(tile: pa.Table) -> pa.Table:
        i, x = tile["i"].to_numpy(), np.stack(tile["x"].to_pylist())
        reach, count = np.full(len(i), np.inf), np.zeros(len(i), np.int64)
        for row, _, d in _least_k(i, x, i, x, k):
            np.add.at(count, row, 1)
            top = np.zeros(len(i))
            np.maximum.at(top, row, d)
            full = np.unique(row)
            reach[full] = np.where(count[full] >= k, top[full], np.inf)
        return pa.table({"i": tile["i"], "x": tile["x"].cast(pa.list_(pa.float64())), "t": tile["t"], "reach": reach})

    reached = cut(rows.groupBy("t").applyInArrow(own, "i bigint, x array<double>, t string, reach double"))
    low = F.array(*[F.min(F.col("x")[c]) for c in range(dims)])
    high = F.array(*[F.max(F.col("x")[c]) for c in range(dims)])
    boxes = cut(reached.groupBy("t").agg(low.alias("low"), high.alias("high"), F.max("reach").alias("reach")))
    strips = max(1, -(-boxes.count() // STRIP))
    total = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    ours = boxes.select(F.pmod(F.xxhash64("t"), F.lit(strips)).cast("int").alias("strip"), F.col("t").alias("a"), "low", "high", "reach")
    theirs = boxes.select(F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.col("t").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    apart = total(F.zip_with(F.zip_with("low_b", "high", lambda x, y: x - y), F.zip_with("low", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    pairs = cut(ours.join(theirs, "strip").where(apart <= F.col("reach") + 1e-8).select("a", "b", "low_b", "high_b"))
    off = total(F.zip_with(F.zip_with("low_b", "x", lambda x, y: x - y), F.zip_with("x", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    left = reached.join(pairs.withColumnRenamed("a", "t"), "t").where(off <= F.col("reach") + 1e-8).select(F.col("t").alias("a"), "b", "i", "x", F.lit(True).alias("asks"))
    right = reached.join(pairs.select("a", F.col("b").alias("t")), "t").select("a", F.col("t").alias("b"), "i", "x", F.lit(False).alias("asks"))

    def meet(both: pa.Table) -> pa.Table:
        asks, i, x = both["asks"].to_numpy(), both["i"].to_numpy(), np.stack(both["x"].to_pylist())
        mine, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = list(_least_k(i[mine], x[mine], i[others], x[others], k)) if len(mine) and len(others) else []
        row, col, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"i": i[mine[row]], "j": i[others[col]], "d": d})

    met = left.union(right).groupBy("a", "b").applyInArrow(meet, "i bigint, j bigint, d double")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= k).drop("r")


def local_outlier_factor(df: DataFrame, key: str, columns: list[str], k: int = 15, contamination: float = 0.05) -> DataFrame:
    """``(key, lof, lof_score, lof_flag)`` of every row: neighbours among all rows; standardised columns, ties by key. ``key`` is a unique whole number; NULLs count as the mean."""
    stats = df.agg(*[s for c in columns for s in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    scaled = df.crossJoin(F.broadcast(stats)).select(F.col(key).cast("long").alias("i"), F.array(*[F.coalesce((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0), F.lit(0.0)) for c in columns]).alias("x"))
    near = cut(nearest(scaled.where("i is not null"), len(columns), k))
    reach = near.groupBy("i").agg(F.max("d").alias("kd"))
    dense = cut(near.join(reach.toDF("j", "kd"), "j").groupBy("i").agg((1 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd")))
    lof = cut(near.join(dense.select(F.col("i").alias("j"), F.col("lrd").alias("other")), "j").groupBy("i").agg(F.avg("other").alias("o")).join(dense, "i").select("i", (F.col("o") / F.col("lrd")).alias("lof")))
    bound = exact_quantiles(lof, [], "lof", [1 - contamination]).select(F.col("q")[0].alias("p"))
    top = lof.agg(F.max(F.greatest(F.lit(0.0), F.col("lof") - 1)).alias("b")).crossJoin(F.broadcast(bound))
    out = lof.crossJoin(F.broadcast(top))
    return out.select(F.col("i").alias(key), F.round("lof", 4).alias("lof"), _clip((F.col("lof") - 1) / F.when(F.col("b") > 0, F.col("b")).otherwise(1.0)).alias("lof_score"), (F.col("lof") > F.col("p")).alias("lof_flag"))


def reconstruction(df: DataFrame, columns: list[str], percentile: float = 0.95) -> DataFrame:
    """Adds ``reconstruction_score``, ``reconstruction_flag``: the error of the standardised row's projection on the first principal components, flagged above the ``percentile``. NULLs count as the mean."""
    means = cut(df.agg(*[F.avg(c).alias(f"{c}_m") for c in columns]))
    filled = df.crossJoin(F.broadcast(means)).withColumns({f"{c}_x": F.coalesce(F.col(c).cast("double"), F.col(f"{c}_m"), F.lit(0.0)) for c in columns}).drop(*[f"{c}_m" for c in columns])
    vectors = VectorAssembler(inputCols=[f"{c}_x" for c in columns], outputCol="v_").transform(filled)
    scaler = StandardScaler(withMean=True, inputCol="v_", outputCol="u_").fit(vectors)
    k = max(1, min(4, len(columns) // 2))
    model = PCA(k=k, inputCol="u_", outputCol="p_").fit(scaler.transform(vectors))
    basis, mean, std = model.pc.toArray(), scaler.mean.toArray(), scaler.std.toArray()
    # rows are projected by plain columns, as they are read more than once
    u = {f"u{i}_": (F.col(f"{c}_x") - float(mean[i])) / float(std[i]) if std[i] > 0 else F.lit(0.0) for i, c in enumerate(columns)}
    p = {f"p{j}_": sum((F.col(f"u{i}_") * float(basis[i, j]) for i in range(len(columns))), F.lit(0.0)) for j in range(k)}
    sq = [F.pow(F.col(f"u{i}_") - sum((F.col(f"p{j}_") * float(basis[i, j]) for j in range(k)), F.lit(0.0)), 2) for i in range(len(columns))]
    error = reduce(lambda a, b: a + b, sq) / len(columns)
    rows = filled.withColumns(u).withColumns(p).withColumn("e_", error).drop(*u, *p)
    bound = rows.agg(F.max("e_").alias("t_")).crossJoin(F.broadcast(exact_quantiles(rows, [], "e_", [percentile]).select(F.col("q")[0].alias("c_"))))
    out = rows.crossJoin(F.broadcast(bound))
    return out.withColumns({"reconstruction_score": _clip(F.col("e_") / F.when(F.col("t_") > 0, F.col("t_")).otherwise(1.0)), "reconstruction_flag": F.col("e_") > F.col("c_")}).drop("e_", "c_", "t_", *[f"{c}_x" for c in columns])


def limits(df: DataFrame, metric: str, y: str, sensors: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Adds ``limit_score``, ``limit_flag``, ``breach``: out of a named sensor's normal range scores 0.6, beyond its critical bound 1.0 and a breach; unnamed metrics score 0."""
    score, breach = F.lit(0.0), F.lit(False)
    for name, (low, high, critical) in (sensors or SENSORS).items():
        own = F.lower(metric).contains(name)
        beyond = F.col(y) < critical if critical < low else F.col(y) > critical
        out = (F.col(y) < low) | (F.col(y) > high)
        score = F.when(own, F.when(beyond, 1.0).when(out, 0.6).otherwise(0.0)).otherwise(score)
        breach = F.when(own, beyond).otherwise(breach)
    return df.withColumns({"limit_score": score, "breach": F.coalesce(breach, F.lit(False))}).withColumn("limit_flag", F.col("limit_score") > 0)


def severity(score: Column, z: Column, breach: Column) -> Column:
    z = F.abs(z)
    return F.when(breach | (score >= 0.85) | (z >= 4), "CRITICAL").when((score >= 0.65) | (z >= 3), "HIGH").when((score >= 0.45) | (z >= 2), "MEDIUM").otherwise("LOW")


Detector = Callable[[DataFrame, list[str], str, str], DataFrame]

#: Detectors by name: ``(df, keys, ts, y)`` -> ``df`` with ``<name>_score`` and ``<name>_flag``.
DETECTORS: dict[str, Detector] = {
    "zscore": lambda df, keys, ts, y: zscore(df, keys, y),
    "mad": lambda df, keys, ts, y: modified_zscore(df, keys, y),
    "iqr": lambda df, keys, ts, y: iqr(df, keys, y),
    "rolling": rolling_zscore,
    "residual": residuals,
}


def add_detector(name: str, detector: Detector) -> None:
    """Makes ``detector`` known as ``name`` to :func:`detect` and :func:`consensus`. The same one may be added again; a name that another has is refused."""
    if not name.isidentifier() or DETECTORS.get(name, detector) is not detector:
        raise ValueError(f"{name!r} is no new name of a detector")
    DETECTORS[name] = detector


def _added(df: DataFrame, keys: list[str], ts: str, y: str, names: list[str]) -> DataFrame:
    for name in names:
        df = DETECTORS[name](df, keys, ts, y)
        if missing := {f"{name}_score", f"{name}_flag"} - set(df.columns):
            raise ValueError(f"detector {name!r} gives no {sorted(missing)}")
    return df


def _votes(names: list[str]) -> tuple[Column, Column]:
    """The detectors whose flag is set, and the highest of their scores; a null flag is no vote."""
    voted = F.array_compact(F.array(*[F.when(F.col(f"{v}_flag"), F.lit(v)) for v in names]))
    return voted, F.greatest(*[F.when(F.col(f"{v}_flag"), F.col(f"{v}_score")).otherwise(0.0) for v in names], F.lit(0.0))


def detect(df: DataFrame, keys: list[str], ts: str, y: str, names: list[str]) -> DataFrame:
    """Every point with ``methods`` (those of ``names`` that flag it, joined by commas), ``votes`` (how many) and ``score`` (the highest of theirs, else 0), by detectors of :data:`DETECTORS`."""
    voted, score = _votes(names)
    return _added(df, keys, ts, y, names).select(*df.columns, F.concat_ws(",", voted).alias("methods"), F.size(voted).alias("votes"), score.alias("score"))


def consensus(df: DataFrame, keys: list[str], ts: str, y: str, metric: str | None = None, extra: list[str] | None = None, detectors: list[str] | None = None) -> DataFrame:
    """Every point with ``expected``, ``score`` (the highest of its votes), ``methods``, ``is_anomaly``, ``severity``: votes of residual, MAD, IQR, limits (with a metric's name), any ``<name>_flag`` of ``extra`` detectors already there, and ``detectors`` of :data:`DETECTORS`, which are run here."""
    rows = zscore(_added(df, keys, ts, y, detectors or []), keys, y)
    rows = _quantiles(cut(residuals(rows, keys, ts, y)), keys, y, [0.25, 0.5, 0.75], "quartiles_")
    rows = iqr(modified_zscore(rows, keys, y, quartiles="quartiles_"), keys, y, quartiles="quartiles_")
    rows = limits(rows, metric, y) if metric else rows.withColumns({"limit_score": F.lit(0.0), "limit_flag": F.lit(False), "breach": F.lit(False)})
    names, score = _votes(["residual", "mad", "iqr", "limit", *(extra or []), *(detectors or [])])
    out = rows.withColumns({"methods": F.concat_ws(",", names), "is_anomaly": F.size(names) > 0, "score": score})
    return out.select(*df.columns, "expected", "score", "methods", "is_anomaly", F.when(F.col("is_anomaly"), severity(F.col("score"), F.col("z"), F.col("breach"))).otherwise("NORMAL").alias("severity"))


def summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, points, anomalies, critical, high, medium, low, pct)``."""
    level = [F.count_if(F.col("severity") == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")]
    return points.groupBy(*keys).agg(F.count("*").alias("points"), F.count_if("is_anomaly").alias("anomalies"), *level).withColumn("pct", F.round(100 * F.col("anomalies") / F.col("points"), 2))
