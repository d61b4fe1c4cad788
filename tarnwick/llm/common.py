"""What several operators of this subpackage share: cutting lineage, joins on hot keys, components, hashed words."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One random 64-bit number for each byte value.
_BYTE_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a cluster it is an error, since executors could not see a folder of the driver's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(key: Column, text: Column) -> Column:
    """A long for each different pair of key and text, null ones too, whatever stands on the other columns."""
    return F.xxhash64(key.cast("string"), key.isNull(), text, text.isNull())


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], times: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each of ``keys`` and in ``times`` how many rows of ``left`` hold it.

    Keys of more than a thousandth of all those rows (fewer than a thousand keys, then) are joined by a
    broadcast, so no task gets all rows of a hot key; the others by a shuffle. ``right`` is read three times.
    """
    total = right.agg(F.coalesce(F.sum(times), F.lit(0))).first()[0]
    is_hot = F.col(times) * 1000 > total
    hot = F.broadcast(right.where(is_hot))
    rest = left.join(F.broadcast(right.where(is_hot).select(*keys)), keys, "left_anti").join(right.where(~is_hot), keys)
    return left.join(hot, keys).unionByName(rest)


#: Links that one task joins by itself.
FEW_LINKS = 20_000


def grouped(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches by the pairs a-b."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for end in (a, b, least[a], least[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _joined(batches):
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if got:
        ends = np.concatenate([np.concatenate(x) for x in zip(*got)])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[grouped(len(nodes), a, b)])], ["node", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links between long ids, by rounds of contraction.

    Each round sends every node to the one of most links among its neighbours and itself (of equal ones, by a
    hash for that round), renames the ends of the links and drops loops and repeats. Stars are gone after one
    round, and the links shrink by a constant factor a round otherwise; no round gathers a component in one
    task. At most :data:`FEW_LINKS` links that are left are joined in one task. Links with a null end are ignored.

    Returns ``(node, component)``, one row per node that has a link to another; ``component`` is the least node.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while left := links.count():
        if left <= FEW_LINKS:
            moves.append(cut(links.repartition(1).mapInArrow(_joined, "node bigint, to bigint")))
            break
        both = links.union(links.select("b", "a")).toDF("node", "near")
        degree = both.groupBy("node").agg(F.count("*").alias("n"))
        rank = lambda n, c: F.struct(F.col(n), F.xxhash64(F.col(c), F.lit(len(moves))), F.col(c).alias("to"))  # noqa: E731, B023
        best = both.join(degree.toDF("near", "n"), "near").groupBy("node").agg(F.max(rank("n", "near")).alias("best"))
        moves.append(cut(best.join(degree, "node").select("node", F.greatest("best", rank("n", "node"))["to"].alias("to"))))
        moved = links
        for end in ("a", "b"):
            moved = moved.join(moves[-1].toDF(end, f"{end}_to"), end)
        links = cut(moved.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    if not moves:
        return links.toDF("node", "component")
    if len(moves) == 1 and left:  # all were joined in one task, which names each part by its least node
        return moves[0].toDF("node", "component")
    roots = moves[-1]
    for step in reversed(moves[:-1]):
        later = roots.toDF("to", "root")
        here = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        roots = here
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return cut(roots.join(least, "to").select("node", "component"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[starts:ends]``; equal spans have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    powers = np.full(n, _ODD, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers, out=sums[1:])
    inverse = np.full(n, _ODD_INVERSE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    at = np.minimum(starts, n - 1)
    return mix((sums[ends] - sums[starts]) * inverse[at] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its offsets (nulls as empty texts)."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered() -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes for which ``is_word``), and the first word of each text."""
    inside = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:] = inside[: len(data)] if len(data) else False
    edge[0] = False
    before, now = edge[:-1], inside
    cut_at = np.zeros(len(data) + 1, bool)
    cut_at[offsets[:-1]] = True
    cut_at = cut_at[: len(data)]
    starts = np.flatnonzero(now & (~before | cut_at))
    ended = np.zeros(len(data) + 1, bool)
    ended[1:] = now
    stops = ended.copy()
    stops[: len(data)] &= ~now | cut_at
    ends = np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def slices(lengths: np.ndarray, most: int):
    """Ranges of consecutive rows with at most ``most`` bytes together, one row at least."""
    first = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if len(lengths) > first:
        yield first, len(lengths)
