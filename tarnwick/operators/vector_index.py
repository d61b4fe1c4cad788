"""Exact nearest vectors by cosine: cells around pivots, and angle bounds that skip cells.

Pivots are a bounded sample of the corpus; every vector goes to the cell of its nearest pivot. By the triangle
inequality of angles no vector of a cell is closer to a query than the pivot's angle less the cell's widest allows. The
``k`` best of a query's first cells bound what the others must reach. Queries and corpus are both tables: they meet
in tiles of bounded size, of which a cell has as many as it needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut

#: Most pivots, vectors of a tile, and queries that meet a tile at once.
PIVOTS, TILE, BLOCK = 256, 4096, 2048
#: Queries whose cells are chosen at once, and scores that a task holds at once.
ASKED, PRODUCTS = 512, 1 << 20
#: Scores have six digits; a bound this much lower cannot hide a tie.
ROOM = 1.1e-6


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; those shorter than 1e-6 are 0."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(length < 1e-6, 0.0, m / np.maximum(length, 1e-6))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cells:
    """``rows(c, v, cell, tile)``: the vectors of ``corpus(c, v)`` as unit vectors in their cells; -1 is the cell of those of length 0. ``low`` and ``high`` bound the angles to a cell's pivot, ``count`` is its size, ``tiles`` what it is split into."""

    def __init__(self, corpus: DataFrame, pivots: int = PIVOTS, tile: int = TILE):
        n = corpus.count()
        wanted = max(1, min(pivots, int(np.sqrt(n))))
        length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        sample = corpus.where(length > 1e-12).orderBy(F.xxhash64("c")).limit(wanted).select("v").toPandas()
        self.pivots = points = unit(_stack(sample["v"])) if len(sample) else np.zeros((0, 0))
        kind = corpus.schema["c"].dataType.simpleString()

        def place(batches):
            for pdf in batches:
                if pdf.empty:
                    continue
                v = unit(_stack(pdf["v"]))
                own, angle = np.full(len(v), -1), np.zeros(len(v))
                full = v.any(1)
                if full.any():
                    cosines = v[full] @ points.T
                    own[full] = cosines.argmax(1)
                    angle[full] = np.arccos(np.clip(cosines.max(1), -1, 1))
                yield pd.DataFrame({"c": pdf["c"], "v": list(v), "cell": own, "angle": angle})

        placed = cut(corpus.mapInPandas(place, f"c {kind}, v array<double>, cell int, angle double"))
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas()
        size = len(points) + 1
        self.count, self.low, self.high = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        at = stats["cell"].to_numpy(int)  # the last place is the cell -1
        self.count[at], self.low[at], self.high[at] = stats["n"], stats["low"], stats["high"]
        self.tiles = -(-self.count // tile)
        parts = F.get(F.array(*[F.lit(int(t)) for t in np.maximum(self.tiles, 1)]), F.when(F.col("cell") < 0, size - 1).otherwise(F.col("cell")))
        self.rows = placed.select("c", "v", "cell", F.pmod(F.xxhash64("c"), parts).cast("int").alias("tile"))

    def __getstate__(self):
        return self.__dict__ | {"rows": None}  # tasks need the bounds alone

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """The highest cosine that a vector of each cell can have with each of the unit vectors ``v``; -inf for empty cells."""
        full = v.any(1)
        out = np.zeros((len(v), len(self.count)))
        if len(self.pivots) and full.any():
            angle = np.arccos(np.clip(v[full] @ self.pivots.T, -1, 1))
            out[full, :-1] = np.cos(np.clip(np.maximum(self.low[:-1] - angle, angle - self.high[:-1]), 0, np.pi))
        out[:, self.count == 0] = -np.inf
        return out

    def choices(self, queries: DataFrame, k: int, rest: bool) -> DataFrame:
        """``(q, v, cells)`` of ``queries(q, v, least)``: each with the best cells that hold ``k`` vectors together, or with ``rest`` those others whose bound reaches ``least``. A query is one row, however many its cells."""
        kind = queries.schema["q"].dataType.simpleString()

        def choose(batches):
            for pdf in batches:
                for a in range(0, len(pdf), ASKED):
                    part = pdf.iloc[a : a + ASKED]
                    v = unit(_stack(part["v"]))
                    bound = self.bounds(v)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(self.count[order], axis=1) - self.count[order]
                    first = np.zeros(bound.shape, bool)
                    np.put_along_axis(first, order, held < k, 1)
                    wanted = ~first & (bound + ROOM >= part["least"].to_numpy(float)[:, None]) if rest else first
                    cells = np.where(np.arange(bound.shape[1]) == len(self.count) - 1, -1, np.arange(bound.shape[1]))
                    yield pd.DataFrame({"q": part["q"].to_numpy(), "v": list(v), "cells": [cells[w] for w in wanted & np.isfinite(bound)]})

        return queries.mapInPandas(choose, f"q {kind}, v array<double>, cells array<int>")

    def visits(self, queries: DataFrame, k: int, rest: bool) -> DataFrame:
        """``(q, v, cell)`` of :meth:`choices`, chosen once; vectors are repeated only as they are read."""
        return cut(self.choices(queries, k, rest)).select("q", "v", F.explode("cells").alias("cell"))

    def meet(self, visits: DataFrame, k: int) -> DataFrame:
        """``(q, c, score)``: of every tile of the cells visited its ``k`` best for each query."""
        q_kind, c_kind = visits.schema["q"].dataType.simpleString(), self.rows.schema["c"].dataType.simpleString()
        tiles = F.get(F.array(*[F.lit(int(t)) for t in self.tiles]), F.when(F.col("cell") < 0, len(self.tiles) - 1).otherwise(F.col("cell")))
        asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a cell at most
        left = visits.join(F.broadcast(asked), "cell").select("q", "v", "cell", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int").alias("block"))
        right = self.rows.join(F.broadcast(asked), "cell").select("c", "v", "cell", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def best(asks: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("c", "ascending")]))
            places = np.zeros((2, 0), np.int64)
            scores = np.zeros(0)
            if asks.num_rows and rows.num_rows:
                places, scores = best_of(_matrix(asks["v"]), _matrix(rows["v"]), k)
            return pa.table({"q": asks["q"].take(pa.array(places[0])), "c": rows["c"].take(pa.array(places[1])), "score": scores})

        by = ["cell", "tile", "block"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, f"q {q_kind}, c {c_kind}, score double")


def best_of(asks: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (of ``asks``, of ``rows``) and scores to six digits of the ``k`` best ``rows`` for each of ``asks``, ties by place; at most ``PRODUCTS`` scores are held at once."""
    places, scores = [], []
    step = max(1, PRODUCTS // len(rows))
    for a in range(0, len(asks), step):
        s = np.round(asks[a : a + step] @ rows.T, 6)
        floor = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k, None] if k < len(rows) else -np.inf
        i, j = np.nonzero(s >= floor)
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[nth < k], j[nth < k]
        places.append(np.stack([i + a, j]))
        scores.append(s[i, j])
    return np.concatenate(places, axis=1), np.concatenate(scores)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).where(F.col("rank") <= k)


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "vector", pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """``(query_key, key, score, rank)``: the exact ``k`` best of all rows for each query, by cosine to six digits, ties by key.

    Null vectors are left out on both sides; vectors shorter than 1e-6 have score 0 with all. ``key`` and ``query_key``
    tell rows apart. At most ``pivots`` vectors, and as many sizes and angles, are known to all tasks.
    """
    rows = corpus.select(F.col(key).alias("c"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    asked = cut(queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null"))
    cells = Cells(cut(rows), pivots, tile)
    first = cut(_ranked(cells.meet(cells.visits(asked.withColumn("least", F.lit(0.0)), k, False), k), k).drop("rank"))
    least = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
    rest = cells.meet(cells.visits(asked.join(least, "q"), k, True), k)
    return _ranked(first.union(rest), k).select(F.col("q").alias(query_key), F.col("c").alias(key), "score", F.col("rank"))
