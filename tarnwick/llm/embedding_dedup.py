"""Embedding near-dedup by int8 tile products with rigorous quantisation error bounds.

Vectors of one label are dealt to cells by their nearest pivot and to tiles of bounded size; a pair of tiles
is skipped where the triangle inequality on the angles to some pivot rules out every link between them. In a
pair of tiles the int8 codes are multiplied exactly; where the product and both vectors' own error bounds
leave a link possible, and only there, the cosine is computed anew in double precision. A task returns each
vector's number of links and one row for the group it met, never the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, grouped, join_by_count

#: Vectors of a tile on average, and rows of it that are multiplied at once.
TILE, ROWS_AT_ONCE = 4096, 512
#: Pivots of a label that are aimed at at most, and vectors that are held against them at once.
MOST_PIVOTS, HELD = 64, 8192
#: Tiles of a label that form a strip.
STRIP = 64
#: Pairs recomputed at once.
AT_ONCE = 1 << 15


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, the length of what the code misses, and the length of what it stands for."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - near, axis=1), np.linalg.norm(near, axis=1)


def possible(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Pairs (row of a, row of b) whose cosine may reach ``threshold``: for unit u, v with codes u', v', |uv - u'v'| <= |u - u'| |v| + |u'| |v - v'|."""
    kind = np.float32 if a[0].shape[1] <= 1040 else np.float64  # sums of int8 products are exact below 2**24
    product = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64) * a[1][:, None] * b[1][None, :]
    bound = a[2][:, None] + a[3][:, None] * b[2][None, :] + 1e-9
    return np.argwhere(product + bound >= threshold)


def links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Pairs (row of x, row of y) with cosine >= ``threshold`` in double precision; of a tile with itself each once."""
    length_x, length_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    codes_x, codes_y = quantise(x / length_x[:, None]), quantise(y / length_y[:, None])
    out = [np.zeros((0, 2), np.int64)]
    for first in range(0, len(x), ROWS_AT_ONCE):
        found = possible(tuple(c[first : first + ROWS_AT_ONCE] for c in codes_x), codes_y, threshold)
        found[:, 0] += first
        if same:
            found = found[found[:, 0] < found[:, 1]]
        for at in range(0, len(found), AT_ONCE):
            part = found[at : at + AT_ONCE]
            i, j = part.T
            out.append(part[np.einsum("ij,ij->i", x[i], y[j]) / (length_x[i] * length_y[j]) >= threshold])
    return np.concatenate(out)


def _stored(vectors: DataFrame, vector: str) -> type:
    return np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def _prepared(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``(k, label, dim, mark, v)``: ``v`` holds the components as given, float or double; dim, mark and v are null for a vector that links with nothing."""
    kind = _stored(vectors, vector)

    def run(batches):
        for batch in batches:
            dims, marks, raws = [], [], []
            for x, tag in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                v = np.array([np.nan if c is None else c for c in x], np.float64) if x else np.zeros(0)
                with np.errstate(over="ignore"):
                    good = tag is not None and len(v) and np.isfinite(v).all() and v.any() and 0 < np.linalg.norm(v) < np.inf
                raw = (v + 0.0).astype(kind).tobytes() if good else None
                dims.append(len(v) if good else None)
                marks.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(marks, pa.binary()), pa.array(raws, pa.binary())], ["k", "label", "dim", "mark", "v"])

    given = vectors.select(F.col(id).cast("long").alias("k"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return given.mapInArrow(run, "k bigint, label string, dim int, mark binary, v binary")


def _placed(classes: DataFrame, kind: type) -> DataFrame:
    """``(label, dim, rep, times, v, cell, angles)``: each vector's angles to the pivots of its label, and the nearest one as its cell.

    Pivots are vectors of the label itself by a share of their hash, one for every two tiles or more; a label of
    few tiles has none and is one cell. They meet the vectors of their label in groups of bounded size.
    """
    sizes = cut(classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    own = ["label", "dim", "rep", "times", "v"]
    per_label = F.least(F.lit(MOST_PIVOTS), F.expr(f"n div {2 * TILE}"))
    if sizes.where(per_label > 1).isEmpty():
        return classes.select(*own, F.lit(0).alias("cell"), F.array().cast("array<double>").alias("angles"))
    sized = join_by_count(classes, sizes, ["label", "dim"], "n").withColumn("pivots", per_label).withColumn("salts", F.ceil(F.col("n") / HELD).cast("int"))
    few = sized.where("pivots <= 1").select(*own, F.lit(0).alias("cell"), F.array().cast("array<double>").alias("angles"))
    many = sized.where("pivots > 1")
    level = F.pmod(F.xxhash64("mark"), F.lit(1 << 40)) / (1 << 40)
    # twice as many as wanted by a share of the hash
    pivots = many.where(level < 2 * F.col("pivots") / F.col("n")).select("label", "dim", "mark", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = many.select(*own, F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"))

    def deal(rows: pa.Table, held: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({**{c: rows[c] for c in own}, "cell": pa.array([], pa.int32()), "angles": pa.array([], pa.list_(pa.float64()))})
        held = held.sort_by("mark")
        x, p = (np.frombuffer(b"".join(t["v"].to_pylist()), kind).astype(float).reshape(len(t), -1) for t in (rows, held))
        angles = np.zeros((len(rows), 0))
        if len(p):
            angles = np.arccos(np.clip(x @ p.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(p, axis=1)), -1, 1))
        cell = angles.argmin(1) if len(p) else np.zeros(len(rows), int)
        offsets = np.arange(len(rows) + 1) * angles.shape[1]
        return pa.table({**{c: rows[c] for c in own}, "cell": pa.array(cell, pa.int32()), "angles": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(angles.ravel()))})

    key = ["label", "dim", "salt"]
    pivots = pivots.toDF(*[f"{c}_" if c in key else c for c in pivots.columns])
    dealt = salted.groupBy(*key).cogroup(pivots.groupBy(*[f"{c}_" for c in key])).applyInArrow(deal, "label string, dim int, rep bigint, times bigint, v binary, cell int, angles array<double>")
    return few.unionByName(dealt)


def _limits(tile: pa.Table) -> pa.Table:
    """The least and greatest angle to each pivot over one tile."""
    angles = tile["angles"].combine_chunks()
    m = angles.flatten().to_numpy().reshape(len(tile), -1)
    low, high = (m.min(0), m.max(0)) if m.shape[1] else (m[0], m[0])
    return pa.table({**{c: tile[c][:1] for c in ("label", "dim", "cell", "part")}, "low": pa.array([low.tolist()], pa.list_(pa.float64())), "high": pa.array([high.tolist()], pa.list_(pa.float64()))})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Two vectors are linked when their labels are equal and not null and their cosine is at least ``threshold``
    (over 0). ``n_links`` counts the other vectors linked directly, equal ones too; ``component_id`` is the
    smallest id reachable by links, itself included; ``kept`` says that it is the row's own. A vector that is
    null, empty or zero, or holds null or non-finite components, links with nothing, as do vectors of different
    lengths. Repeated ids count as one vector each row; a null id has no component and is not kept. Other columns are left out.
    """
    kind = _stored(vectors, vector)
    given = cut(_prepared(vectors, id, vector, label))
    group = ["label", "dim", "mark"]
    classes = cut(given.where("mark is not null and k is not null").groupBy(*group).agg(F.min("k").alias("least"), F.count("*").alias("times"), F.any_value("v").alias("v")).withColumn("rep", F.xxhash64(*group)))
    placed = cut(_placed(classes, kind))
    cells = cut(placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / TILE).cast("int")
    tiled = join_by_count(placed, cells, ["label", "dim", "cell"], "n").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    tile = ["label", "dim", "cell", "part"]
    limits = tiled.select(*tile, "angles").groupBy(*tile).applyInArrow(_limits, "label string, dim int, cell int, part int, low array<double>, high array<double>")
    tiles = cut(limits.select("label", "dim", F.struct("cell", "part").alias("tile"), "low", "high"))
    # every tile meets those of its label in strips, so that a label of many tiles is many keys
    counted = cut(tiles.groupBy("label", "dim").agg(F.count("*").alias("n")))
    of = join_by_count(tiles, counted, ["label", "dim"], "n").withColumn("strips", F.ceil(F.col("n") / STRIP).cast("int"))
    ours = of.select("label", "dim", F.pmod(F.xxhash64("tile"), F.col("strips")).cast("int").alias("strip"), F.col("tile").alias("a"), "low", "high")
    theirs = of.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"), F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    reach = float(np.arccos(threshold)) + 1e-6
    gap = F.zip_with(F.zip_with("low_b", "high", lambda x, y: x - y), F.zip_with("low", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    pairs = ours.join(theirs, ["label", "dim", "strip"]).where((F.col("a") <= F.col("b")) & ~F.exists(gap, lambda x: x > reach)).select("label", "dim", "a", "b")
    ends = pairs.select("label", "dim", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    rows = tiled.select("label", "dim", F.struct("cell", "part").alias("tile"), "rep", "times", "v").join(ends, ["label", "dim", "tile"]).select("label", "dim", "a", "b", (F.col("tile") == F.col("a")).alias("first"), "rep", "times", "v")

    def compare(table: pa.Table) -> pa.Table:
        first = table["first"].to_numpy()
        same = table["a"][0] == table["b"][0]
        raw = b"".join(table["v"].to_pylist())
        x = np.frombuffer(raw, kind).astype(np.float64).reshape(len(first), -1)
        rep, times = table["rep"].to_numpy(), table["times"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        found = links(x[left], x[right], threshold, same)
        a, b = left[found[:, 0]], right[found[:, 1]]
        n = np.bincount(a, times[b], len(first)) + np.bincount(b, times[a], len(first))
        own = np.flatnonzero(n)
        return pa.table({"rep": rep[own], "near": n[own].astype(np.int64), "to": rep[grouped(len(first), a, b)[own]]})

    met = cut(rows.groupBy("label", "dim", "a", "b").applyInArrow(compare, "rep bigint, near bigint, to bigint"))
    counts = met.groupBy("rep").agg(F.sum("near").alias("near"))
    held = components(met.select(F.col("rep").alias("a"), F.col("to").alias("b"))).toDF("rep", "node")
    heads = cut(held.join(classes.select("rep", "least"), "rep").groupBy("node").agg(F.min("least").alias("component"), F.count("*").alias("classes")))
    linked = join_by_count(held, heads, ["node"], "classes").select("rep", "component")
    named = classes.select(*group, "rep", "least", "times").join(counts, "rep", "left").join(linked, "rep", "left")
    marks = cut(named.select(*group, "times", (F.coalesce("near", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "least").alias("component")))
    known = join_by_count(given.where("mark is not null and k is not null").select("k", *group), marks, group, "times").select("k", "n_links", "component")
    alone = given.where("mark is null or k is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component"))
    return known.unionByName(alone).select(F.col("k").alias(id), "n_links", F.col("component").alias("component_id")).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False)))
