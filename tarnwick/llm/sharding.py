"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, no group of equal texts divided.

Differencing keeps a heap of partial partitions, each a way to split some of the groups over all shards, and
joins the two with the largest spread, the heaviest part of one with the lightest of the other. Here blocks
of groups are differenced side by side in tasks of bounded size; the partial partition that is left of each
block is an item of the next level, until one block holds them all, with the heaviest groups and enough light
ones to level them. Only sums travel between levels.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, join_by_count


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join partial partitions (rows of sums) into one. Returns ``(to, sums)``: part j of row i goes to slot ``to[i, j]`` of the one that is left, whose sums ascend by slot."""
    n, k = parts.shape
    order = np.argsort(parts, axis=1, kind="stable")
    sums = {i: np.take(parts[i], order[i]) for i in range(n)}
    heap = [(-int(sums[i][-1] - sums[i][0]), i) for i in range(n)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, int, np.ndarray]] = []
    made = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        by = np.argsort(both, kind="stable")
        new = both[by]
        rank = np.empty(k, np.int64)
        rank[by] = np.arange(k)
        sums[made] = new
        joins.append((made, a, b, rank))
        heapq.heappush(heap, (-int(new[-1] - new[0]), made))
        made += 1
    top = heap[0][1]
    place = {top: np.arange(k)}
    for node, a, b, rank in reversed(joins):
        at = place.pop(node)
        place[a] = at[rank]
        place[b] = at[rank[::-1]]
    to = np.empty((n, k), np.int64)
    for i in range(n):
        to[i, order[i]] = place[i]
    return to, sums[top]


def _level(items: DataFrame, kind: str, n_shards: int) -> DataFrame:
    """Difference each block of ``(block, item, sums)``: a row ``(block, item, to)`` for each item and one ``(block, null, sums)`` for what is left. A sum alone stands for a part with nothing beside it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable", ignore_index=True)
        single = len(rows["sums"].iloc[0]) == 1
        parts = np.zeros((len(rows), n_shards), np.int64)
        parts[:, n_shards - 1 if single else slice(None)] = np.array(rows["sums"].str[0], np.int64) if single else np.stack(rows["sums"].to_numpy())
        to, left = difference(parts)
        out = [[int(x[-1])] for x in to] if single else to.tolist()
        return pd.DataFrame({"block": rows["block"].iloc[0], "item": [*rows["item"], None], "to": [*out, left.tolist()]})

    return items.groupBy("block").applyInPandas(run, f"block string, item {kind}, to array<bigint>")


def balance(groups: DataFrame, n_shards: int, block_items: int = 4096) -> DataFrame:
    """``(item, shard)`` for ``groups`` of ``(item binary, weight long)``, ``item`` unique and not null.

    Blocks come out level to a few bytes, so they cannot fill the gaps that heavy groups leave. Groups heavier than a shard's
    share / 64 (at most 64 * ``n_shards``, and one more a shard) are therefore items of the last block, and beside them
    stand light groups with some twice the heaviest group's bytes for each shard (all, if there are not as many), summed
    to at most ``block_items`` by a hash. Where a block holds twice the heaviest group for each shard, blocks take all groups.
    Where there are at most ``block_items`` groups each is an item of one block. Fewer groups than shards: the other
    shards stay empty.
    """
    groups = cut(groups.select("item", "weight"))
    n, total, most = groups.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    level_by_themselves = 2 * n_shards * most * n <= total * block_items
    heavy = F.lit(True) if n <= block_items else F.lit(False) if level_by_themselves else F.col("weight") > total / (n_shards * 64)
    light = groups.where(~heavy).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    share = 0.0 if level_by_themselves else min(1.0, max(2 * n_shards * most / light, 2 * block_items / n)) if light else 1.0
    spread = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "item"), F.lit(m)).cast("string")
    block = F.concat(F.lit("block "), spread(0, max(1, -(-int(n * (1 - share)) // block_items))))
    filler = F.pmod(F.xxhash64(F.lit(1), "item"), F.lit(1 << 20)) < share * (1 << 20)
    # sums from large to a thousandth of that, so that small ones level what larger ones leave
    even = F.pmod(F.xxhash64(F.lit(2), "item"), F.lit(1 << 40)) / (1 << 40)
    summed = F.concat(F.lit("sum "), F.floor(F.log1p(even * 999) / float(np.log(1000)) * block_items).cast("string"))
    part = F.when(heavy, F.concat(F.lit("group "), F.hex("item"))).when(filler, summed).otherwise(block)
    parts = cut(groups.select("item", "weight", part.alias("part")))
    in_block = F.startswith("part", F.lit("block "))
    level = cut(_level(parts.where(in_block).select(F.col("part").alias("block"), "item", F.array("weight").alias("sums")), "binary", n_shards))
    placed = level.where("item is not null").select("item", F.col("block").alias("part"), F.col("to")[0].alias("slot"))
    placed = placed.unionByName(parts.where(~in_block).select("item", "part", F.lit(n_shards - 1).cast("long").alias("slot")))
    alone = parts.where(~in_block).groupBy("part").agg(F.sum("weight").alias("weight"))
    alone = alone.select(F.col("part").alias("item"), F.concat(F.array_repeat(F.lit(0).cast("long"), n_shards - 1), F.array("weight")).alias("sums"))
    rounds = 0
    while True:
        tops = level.where("item is null").select(F.col("block").alias("item"), F.col("to").alias("sums"))
        blocks, rounds = -(-tops.count() // block_items), rounds + 1
        last = blocks <= 1
        items = tops.unionByName(alone) if last else tops
        level = cut(_level(items.select(F.concat(F.lit(f"level {rounds}, "), F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))).cast("string")).alias("block"), "item", "sums"), "string", n_shards))
        moves = level.where("item is not null").select(F.col("item").alias("part"), F.col("block").alias("above"), "to")
        # parts of the last block wait for it
        placed = placed.join(moves, "part", "left").select("item", F.coalesce("above", "part").alias("part"), F.coalesce(F.expr("to[slot]"), "slot").alias("slot"))
        if last:
            return placed.select("item", F.col("slot").cast("int").alias("shard"))


def shard(docs: DataFrame, n_shards: int = 24, text: str = "text", key: str = "doc_id", slots_at_once: int = 2000) -> DataFrame:
    """Put every row of ``docs`` into one of ``n_shards`` shards by the law ``bytes``.

    Returns ``(key, size, text_crc32, law, shard, slot, grown_shard)``. ``size`` is the text's UTF-8 bytes (a
    null text: none) plus 8; equal texts share a shard, null texts too; ``slot`` counts a shard's rows from 0
    without gaps; ``grown_shard`` is null under this law. ``text_crc32`` is null for a null text. Repeated rows
    each get a slot, null keys too. No rows: none. Other columns are left out.
    """
    t = F.col(text).cast("string")
    rows = cut(
        docs.select(
            F.col(key).alias("k"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("crc"),
            F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b"")).alias("item"),
        )
    )
    groups = cut(rows.groupBy("item").agg(F.sum("size").alias("weight"), F.count("*").alias("times")))
    placed = join_by_count(rows, cut(balance(groups, n_shards).join(groups.select("item", "times"), "item")), ["item"], "times").drop("item", "times")
    spread = max(1, rows.count() // (n_shards * slots_at_once))
    placed = cut(placed.withColumn("bucket", F.pmod(F.xxhash64("k", "crc"), F.lit(spread))))
    own = Window.partitionBy("shard", "bucket")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    return placed.withColumn("at", F.row_number().over(own.orderBy("k", "crc"))).join(before, ["shard", "bucket"]).select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
