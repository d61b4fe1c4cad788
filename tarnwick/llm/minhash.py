"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash makes all coordinates of a signature from two permutations: one spreads the shingles over
the places of a circle, and coordinate k is the least value that the second takes over those places shifted
by k. Rows that agree on a whole band are candidates; each link is confirmed on the full shingle sets.

Copies with equal sets stand as one class. In a bucket every class is first compared with the bucket's hub
(the member with most company over all its buckets); what the confirmed links already hold together needs
no further look. All classes that met under one hub are then compared across components: those apart from
the hub's against all, in tiles of bounded size that return links and never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, free_name, grouped, join_by_count, lowered, mix, row_key, slices, span_hashes, spans, utf8

#: Rows in a band, and the chance with which a pair just at the bound may miss every band.
ROWS, MISSED = 5, 5e-7
#: Places on the circle.
PLACES = 1 << 18
#: Bytes of text that one step handles.
STEP_BYTES = 1 << 19
#: Classes, and shingles, of one side of a tile on average.
TILE, TILE_SHINGLES = 512, 1 << 20
#: What tells shingle sets apart.
MARK = ["n", "h1", "h2"]
_LOWER = lowered()
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_SECOND: dict[int, np.ndarray] = {}


def bands_for(percent: int) -> int:
    """Bands that a pair of ``percent`` similarity misses with a chance of :data:`MISSED` at most: 25 at 85, 37 at 80."""
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min(percent / 100, 1 - 1e-9) ** ROWS))))


def _second(width: int) -> np.ndarray:
    """The second permutation, its first ``width`` values repeated at the end, as overlapping windows."""
    if width not in _SECOND:
        own = np.random.default_rng(7).permutation(PLACES).astype(np.uint32)
        _SECOND[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([own, own[: width - 1]]), width)
    return _SECOND[width]


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, end to end and sorted in each, and their offsets. A text of fewer words than ``size`` has its whole sequence as one; one without words has none."""
    data, offsets = utf8(texts)
    data = _LOWER[data]
    starts, ends, first = spans(data, offsets, _WORD)
    words = span_hashes(data, starts, ends)
    n = np.diff(first)
    windows = np.maximum(n - size + 1, np.minimum(n, 1))
    upto = np.concatenate([[0], np.cumsum(windows)])
    at = np.repeat(first[:-1] - upto[:-1], windows) + np.arange(upto[-1])
    length = np.repeat(np.minimum(n, size), windows)
    out = length.astype(np.uint64)
    last = max(len(words) - 1, 0)
    for k in range(size):
        word = words[np.minimum(at + k, last)] if len(words) else words
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, word, np.uint64(k)))
    sets = [np.unique(out[a:b]) for a, b in zip(upto[:-1], upto[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else out), np.concatenate([[0], np.cumsum(sizes)])


def signature(hashes: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The circulant signatures of non-empty sets, one row each."""
    place = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PLACES)).astype(np.int64)
    windows, out = _second(width), np.empty((len(offsets) - 1, width), np.uint32)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        least = None
        for at in range(a, b, 4096):
            part = windows[place[at : min(b, at + 4096)]].min(0)
            least = part if least is None else np.minimum(least, part)
        out[i] = least
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band."""
    n, count = len(signatures), signatures.shape[1] // ROWS
    parts = signatures.reshape(n, count, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (n, count)).copy()
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def _signed(docs: DataFrame, size: int, count: int) -> DataFrame:
    """``(r, k, n, h1, h2, buckets)`` of ``docs(r, k, t)``: set size, a 128-bit mark of the set and its ``count`` bands' buckets (none for an empty set)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)), STEP_BYTES):
                hashes, offsets = shingles(texts.slice(a, b - a), size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                marks = np.zeros((2, len(n)), np.int64)
                buckets = np.zeros((0, count), np.uint64)
                if len(full):
                    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        marks[k, full] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), offsets[:-1][full]).view(np.int64)
                    buckets = bands(signature(hashes, np.concatenate([offsets[:-1][full], offsets[-1:]]), ROWS * count))
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, count, 0))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), pa.array(marks[0]), pa.array(marks[1]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(buckets.ravel().view(np.int64)))], ["r", "k", "n", "h1", "h2", "buckets"])

    return docs.mapInArrow(run, "r bigint, k bigint, n bigint, h1 bigint, h2 bigint, buckets array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``(r, s)``: the shingle set, as bytes, of each of ``docs(r, t)`` with its ``r`` in ``wanted(r)``; one row each."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)), STEP_BYTES):
                hashes, offsets = shingles(texts.slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([hashes[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], pa.binary())], ["r", "s"])

    return docs.join(wanted, "r", "left_semi").mapInArrow(run, "r bigint, s binary").dropDuplicates(["r"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets have 100 * intersection >= ``percent`` * union."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                both = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.toDF("a", "first"), "a").join(sets.toDF("b", "second"), "b").select("a", "b", "first", "second")
    return full.mapInArrow(compare, "a bigint, b bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``, by products of incidence matrices over the shingles that both sides hold."""
    sizes = [len(x) for x in (*left, *right)]
    flat = np.concatenate([*left, *right]) if sizes else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, at = np.unique(flat, return_inverse=True)
    ours = row < len(left)
    both = np.flatnonzero((np.bincount(at[ours], minlength=at.max(initial=-1) + 1) > 0) & (np.bincount(at[~ours], minlength=at.max(initial=-1) + 1) > 0))
    column = np.full(at.max(initial=-1) + 1, -1)
    column[both] = np.arange(len(both))
    column = column[at]
    out = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(0, len(both) + wide, wide))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        cells = order[a:b]
        held = np.zeros((len(sizes), wide), np.float32)
        held[row[cells], column[cells] - k * wide] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes of different parts of ``members(hub, rep, n, part, hub_part)``, or others that join the same: each class apart from its hub against all of the hub's, tile by tile."""
    away = F.col("part") != F.col("hub_part")
    count = lambda c, s: F.ceil(F.greatest(c / TILE, s / TILE_SHINGLES)).cast("int")
    grids = cut(members.groupBy("hub").agg(count(F.count_if(away), F.sum(F.when(away, F.col("n")))).alias("across"), count(F.count("*"), F.sum("n")).alias("down"), F.count("*").alias("all")))
    held = join_by_count(members, grids, ["hub"], "all").where("across > 0 and all > 1")
    deal = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    ours = held.where(away).select("hub", "rep", "n", "part", F.lit(True).alias("ours"), deal("across").alias("i"), every("down").alias("j"))
    theirs = held.select("hub", "rep", "n", "part", F.lit(False).alias("ours"), every("across").alias("i"), deal("down").alias("j"))
    tiles = ours.union(theirs).join(sets.withColumnRenamed("r", "rep"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        side, rep, part, n = (table[c].to_numpy() for c in ("ours", "rep", "part", "n"))
        x, y = np.flatnonzero(side), np.flatnonzero(~side)
        full = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["s"]]
        both = overlaps([full[k] for k in x], [full[k] for k in y])
        hit = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & (part[x][:, None] != part[y][None, :])
        i, j = np.nonzero(hit)
        nodes, at = np.unique(rep, return_inverse=True)
        least = grouped(len(nodes), at[x[i]], at[y[j]])
        own = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.table({"a": nodes[own], "b": nodes[least[own]]})

    return tiles.groupBy("hub", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _grouped(given: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """For ``given(r, k, t)``: rows ``(r, k, n, h1, h2)``, and ``(n, h1, h2, times, head)`` for each shingle set that some row has.

    ``head`` is the row ``(no_key, k, r)`` with the least key (null last, then by ``r``) of all that the set's
    rows reach. Texts with equal sets are one class, which goes by the least ``r`` of its rows.
    """
    signed = cut(_signed(given, size, bands_for(percent)))
    classes = cut(signed.where("n > 0").groupBy(*MARK).agg(F.min("r").alias("rep"), F.min(F.struct(F.col("k").isNull().alias("no_key"), "k", "r")).alias("head"), F.count("*").alias("times"), F.any_value("buckets").alias("buckets")))
    postings = classes.select(F.explode("buckets").alias("bucket"), "rep", "n")
    shared = cut(postings.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    live = cut(join_by_count(postings, shared, ["bucket"], "size"))
    company = live.groupBy("rep").agg(F.sum("size").alias("company"))
    hubs = cut(live.join(company, "rep").groupBy("bucket", "size").agg(F.max_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), F.struct("company", -F.col("rep"))).alias("h")).select("bucket", "size", "h.*"))
    starred = cut(join_by_count(live.select("bucket", "rep", "n"), hubs, ["bucket"], "size"))
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    stars = starred.where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    sets = cut(shingle_sets(given.select("r", "t"), live.select(F.col("rep").alias("r")).distinct(), size))
    links = cut(confirm(stars, sets, percent))
    held = components(links)
    members = starred.where("rep <> hub").select("hub", "rep", "n").distinct().join(held.toDF("rep", "rep_part"), "rep", "left").join(held.toDF("hub", "hub_part"), "hub", "left")
    members = cut(members.select("hub", "rep", "n", F.coalesce("rep_part", "rep").alias("part"), F.coalesce("hub_part", "hub").alias("hub_part")))
    final = components(links.union(_across(members, sets, percent))).toDF("rep", "node")
    heads = cut(final.join(classes.select("rep", "head"), "rep").groupBy("node").agg(F.min("head").alias("first"), F.count("*").alias("classes")))
    linked = join_by_count(final, heads, ["node"], "classes").select("rep", "first")
    groups = classes.select(*MARK, "times", "rep", "head").join(linked, "rep", "left").select(*MARK, "times", F.coalesce("first", "head").alias("head"))
    return signed.select("r", "k", *MARK), cut(groups)


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; two texts are linked when 100 *
    intersection >= ``percent`` * union of their distinct ``size``-word shingles. ``component_id`` is the
    smallest key reachable by links, itself included; ``kept`` says that it is the row's own. A null, empty or
    blank text has no shingles and links with nothing. A repeated row is in its own component; texts under one
    key each have their own links. A row with a null key has the smallest key of those it reaches, null if they
    have none, and is never kept. Texts of any length are read whole. Other columns are left out.
    """
    t = F.col(text).cast("string")
    rows, groups = _grouped(docs.select(row_key(F.col(key), t).alias("r"), F.col(key).cast("long").alias("k"), t.alias("t")), percent, size)
    full = join_by_count(rows.where("n > 0"), groups, MARK, "times").select("k", "n", F.col("head.k").alias("component_id"))
    out = full.unionByName(rows.where("n = 0").select("k", "n", F.col("k").alias("component_id")))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def without_copies(docs: DataFrame, percent: int = 80, size: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, but for near-duplicates: of each group one stays, the one of least key (a null key comes last).

    Of rows with the same key and text one stays, also if the text is null or blank; texts without words are
    otherwise no copies. Different texts under one key are judged each by itself.
    """
    t, mark = F.col(text).cast("string"), free_name(docs, "r")
    docs_r = docs.withColumn(mark, row_key(F.col(key), t))
    rows, groups = _grouped(docs_r.select(F.col(mark).alias("r"), F.col(key).cast("long").alias("k"), t.alias("t")), percent, size)
    keep = groups.select(F.col("head.r").alias(mark)).distinct().union(rows.where("n = 0").select("r").distinct())
    if not rows.groupBy("r").count().where("count > 1").isEmpty():
        docs_r = docs_r.dropDuplicates([mark])
    return docs_r.join(keep, mark, "left_semi").select(*docs.columns)
