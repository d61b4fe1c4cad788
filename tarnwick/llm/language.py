"""Language ID: averaged hashed subword embeddings with a linear softmax, temperature and rejection calibrated.

Subwords are runs of one to four bytes of the lower-cased text that reach over no white space but at their
ends; each is hashed to a bucket with an embedding, a text is the mean over its whole length, and a linear
softmax follows. The model starts from gradient steps on a hashed sample, and then learns from all labelled rows in
blocks, each a task's, whose models are averaged. Temperature and the score under which a text is rejected come from
all rows of a fifth that the model has not seen. Texts are counted and judged in the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import cut
from .common import slices, utf8

BUCKETS, WIDTH, LONGEST = 4096, 16, 4
UNKNOWN = "und"
#: Rows and bytes of a block of training rows on average, and the epochs, steps at least and rate by which each refines the model.
BLOCK_ROWS, BLOCK_BYTES, EPOCHS, STEPS, RATE = 2000, 32 << 20, 5, 300, 8.0
#: Bytes that one step handles; each text counts as its table of buckets at least.
STEP_BYTES = 1 << 19
#: ASCII letters in lower case, bytes of other scripts as they are, everything else white space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's buckets (a row each), and whether the text has letters."""
    data, offsets = utf8(texts)
    data = _FOLD[data]
    n, rows = len(data), len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, np.int64)
    blank = data == 32
    row = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, np.diff(offsets))
    stop = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    wide = data.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    inner = np.ones(n, bool)
    for k in range(1, LONGEST + 1):
        m = n - k + 1
        if m <= 0:
            break
        code = code[:m] | wide[k - 1 :] << np.uint64(8 * (k - 1))
        if k > 2:
            inner = inner[:m] & ~blank[k - 2 : n - 1]
        use = inner[:m] & (stop[:m] >= k) & ~(blank[:m] & blank[k - 1 :])
        bucket = (code[use] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xD6E8FEB86659FD93 % 2**64)) >> np.uint64(52)
        counts += np.bincount(row[:m][use] + bucket.astype(np.int64), minlength=rows * BUCKETS)
    ascii_letters = (data < 128) & ~blank
    total = np.concatenate([[0], np.cumsum(ascii_letters)])
    letters = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
        letters[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return counts.reshape(rows, BUCKETS), letters


def _steps(texts: pa.Array):
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    return slices(sizes + BUCKETS, STEP_BYTES)


def _means(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the key as text leaves 2 by 4. A null key isn't one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Embeddings, linear layer, temperature and the score under which a text is rejected."""

    def __init__(self, langs: list[str], vectors: np.ndarray, linear: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.langs, self.vectors, self.linear, self.bias, self.temperature, self.least = langs, vectors, linear, bias, temperature, least

    def logits(self, means: np.ndarray) -> np.ndarray:
        return means @ self.vectors @ self.linear + self.bias

    def scores(self, means: np.ndarray) -> np.ndarray:
        z = self.logits(means) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(means: np.ndarray, langs: np.ndarray, epochs: int = 40, rate: float = 32.0, batch: int = 32, seed: int = 1, least_steps: int = 1500, start: Model | None = None) -> Model:
    """Fit ``means`` of buckets by gradient steps, from ``start`` or from random embeddings. Few rows go through more epochs, ``least_steps`` steps at least."""
    random = np.random.default_rng(seed)
    if start is None:
        names = sorted(set(langs))
        model = Model(names, random.normal(0, 0.5, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(names))), np.zeros(len(names)))
    else:
        model = Model(start.langs, start.vectors.copy(), start.linear.copy(), start.bias.copy())
    y = np.searchsorted(model.langs, langs)
    per_epoch = -(-len(y) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps = epochs * per_epoch
    done = 0
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(y)), per_epoch):
            x = means[part]
            hidden = x @ model.vectors
            p = model.scores(x)
            p[np.arange(len(part)), y[part]] -= 1
            p *= rate * (1 - done / steps) / len(part)
            pull = p @ model.linear.T
            model.linear -= hidden.T @ p
            model.bias -= 0.1 * p.sum(0)
            model.vectors -= x.T @ pull
            done += 1
    return model


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Means of the buckets of the texts with letters, and which texts those are."""
    means, kept = [np.zeros((0, BUCKETS), np.float32)], []
    for a, b in _steps(texts):
        counts, letters = subwords(texts.slice(a, b - a))
        means.append(_means(counts[letters]).astype(np.float32))
        kept.append(letters)
    return np.concatenate(means), np.concatenate(kept) if kept else np.zeros(0, bool)


def widened(model: Model, langs: list[str]) -> Model:
    """``model`` for ``langs``, those besides its own with weights of 0."""
    linear, bias = np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    at = np.searchsorted(langs, model.langs)
    linear[:, at], bias[at] = model.linear, model.bias
    return Model(langs, model.vectors, linear, bias)


def refine(rows: DataFrame, start: Model, n: int, size: int) -> Model:
    """``start`` after gradient steps on all of the ``n`` ``rows(t, l)`` of ``size`` bytes.

    Rows are dealt by a hash to blocks of ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` bytes on average. Each block takes its steps from ``start``
    in a task of its own, and the models are averaged by their rows, in groups before they reach the driver.
    """
    blocks = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES))
    groups = int(np.ceil(np.sqrt(blocks)))
    dealt = rows.select("t", "l", F.xxhash64("t", "l", "k").alias("h")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))

    def step(block: pa.Table) -> pa.Table:
        block = block.sort_by([("h", "ascending"), ("l", "ascending")])
        means, kept = _features(block["t"].combine_chunks())
        langs = np.array(block["l"].to_pylist(), object)[kept].astype(str)
        model = fit(means, langs, EPOCHS, RATE, seed=2, least_steps=STEPS, start=start) if len(langs) else start
        weights = np.concatenate([w.ravel() for w in (model.vectors, model.linear, model.bias)]) * len(langs)
        return pa.table({"block": block["block"].slice(0, 1), "n": pa.array([len(langs)], pa.int64()), "w": pa.array([weights.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        weights = sum(np.frombuffer(w.as_py()) for w in group["w"])
        return pa.table({"block": group["block"].slice(0, 1), "n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "w": pa.array([weights.tobytes()], pa.binary())})

    fields = "block int, n bigint, w binary"
    stepped = dealt.repartition(blocks, "block").groupBy("block").applyInArrow(step, fields)
    got = sorted(stepped.groupBy((F.col("block") % groups).alias("group")).applyInArrow(lambda g: add(g.select(["block", "n", "w"])), fields).collect(), key=lambda r: r["block"])
    total = sum(r["n"] for r in got)
    if not total:
        return start
    weights = sum(np.frombuffer(r["w"]) for r in got) / total
    vectors, linear, bias = np.split(weights, [start.vectors.size, start.vectors.size + start.linear.size])
    return Model(start.langs, vectors.reshape(start.vectors.shape), linear.reshape(start.linear.shape), bias)


def calibrate(model: Model, held: DataFrame, rejected: float) -> None:
    """Set temperature and the least accepted score of ``model`` from all of ``held(l, z)``, logits of rows that it has not seen.

    The temperature is the one of least log loss. The bound is the score under which the share ``rejected`` of
    the rightly judged rows falls: the k-th smallest with k = rejected * (n + 1), rounded down; with k = 0 there
    are too few rows to tell and nothing is rejected. Losses are added up and scores sorted by Spark.
    """
    known = held.where(F.col("l").isin(model.langs))
    heats = np.geomspace(0.25, 8, 60)

    def logits(batch):
        return batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), np.searchsorted(model.langs, batch.column(0).to_numpy(zero_copy_only=False).astype(str))

    def losses(batches):
        for batch in batches:
            if batch.num_rows:
                z, y = logits(batch)
                s = z[None] / heats[:, None, None]
                s -= s.max(2, keepdims=True)
                lost = (np.log(np.exp(s).sum(2)) - s[:, np.arange(len(z)), y]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(heats))), pa.array(lost)], ["heat", "loss"])

    lost = {r["heat"]: r["loss"] for r in known.mapInArrow(losses, "heat bigint, loss double").groupBy("heat").agg(F.sum("loss").alias("loss")).collect()}
    if not lost:
        return
    model.temperature = float(heats[min(sorted(lost), key=lambda i: round(lost[i], 6))])

    def right(batches):
        for batch in batches:
            if batch.num_rows:
                z, y = logits(batch)
                s = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
                s /= s.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.max(1)[s.argmax(1) == y])], ["s"])

    scores = known.mapInArrow(right, "s double")
    k = int(rejected * (scores.count() + 1))
    model.least = float(scores.orderBy("s").limit(k).agg(F.max("s")).first()[0]) if k else 0.0


def train(docs: DataFrame, sample: int = 3000, rejected: float = 2e-3, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of all rows that aren't held out and have text with letters and language; None if there are none.

    A fifth of the rows by a hash of the key is for calibration only (but for languages that have no others). About ``sample`` of the others, an equal
    share for each language, are taken to the driver for the model to start from; then all of them are learned from (:func:`refine`), and
    that whole fifth calibrates. ``rejected`` is the share of rightly judged texts that may be rejected.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(~held_out(F.col("k")) & F.col("t").rlike(r"\p{L}") & F.col("l").isNotNull())
    level = lambda salt: F.pmod(F.xxhash64("k", F.lit(salt)), F.lit(1 << 40)) / (1 << 40)
    apart = level("calibration") < 0.2
    counted = rows.groupBy("l").agg(F.count_if(~apart).alias("n"), F.count_if(apart).alias("c"), F.sum(F.octet_length("t")).alias("size")).collect()
    counts = {r["l"]: (r["n"], r["c"]) for r in counted}
    if not counts:
        return None
    share = {name: n or c for name, (n, c) in counts.items()}
    only = [name for name, (n, _) in counts.items() if not n]  # languages of so few rows that none is left to learn from
    own = ~apart | F.col("l").isin(only)
    each = max(1, sample // len(share))
    chosen = F.coalesce(*(F.when(F.col("l") == name, level("sample") < min(1.0, each / n)) for name, n in share.items()))

    def run(batches):
        for batch in batches:
            for a, b in _steps(batch.column(1)):
                counts, letters = subwords(batch.column(1).slice(a, b - a))
                kept = np.flatnonzero(letters)
                out = [np.flatnonzero(counts[i]) for i in kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(kept)), batch.column(2).slice(a, b - a).take(pa.array(kept)), pa.array([x.astype(np.int16).tobytes() for x in out], pa.binary()), pa.array([counts[i][x].astype(np.int32).tobytes() for i, x in zip(kept, out)], pa.binary())], ["k", "l", "i", "c"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.where(chosen & own).mapInArrow(run, f"k {kind}, l string, i binary, c binary").toPandas().sort_values(["k", "l"], kind="stable", ignore_index=True)
    langs = sorted(counts)
    if got.empty:  # by chance none of few rows is chosen
        start = Model(langs, np.random.default_rng(1).normal(0, 0.5, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(langs))), np.zeros(len(langs)))
    else:
        means = np.zeros((len(got), BUCKETS), np.float32)
        for row, (i, c) in enumerate(zip(got["i"], got["c"])):
            c = np.frombuffer(c, np.int32)
            means[row, np.frombuffer(i, np.int16)] = c / max(int(c.sum()), 1)
        start = widened(fit(means, got["l"].to_numpy(str)), langs)
        del got, means
    model = refine(rows.where(own), start, sum(share.values()), sum(r["size"] for r in counted))

    def judged(batches):
        for batch in batches:
            for a, b in _steps(batch.column(1)):
                counts, letters = subwords(batch.column(1).slice(a, b - a))
                z = model.logits(_means(counts[letters]))
                offsets = np.arange(len(z) + 1, dtype=np.int32) * len(model.langs)
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(a, b - a).filter(pa.array(letters)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))], ["l", "z"])

    calibrate(model, cut(rows.where(~own).mapInArrow(judged, "l string, z array<double>")), rejected)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    ``und`` with score 0, not accepted: a null text, one without letters, or no model. Ties go to the first
    language by name. Texts are read whole; rows are kept as they are, repeated ones too. The columns kept come
    first, whatever their names; :func:`known` takes those of accepted rows alone.
    """
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema[: len(keep)])
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in _steps(texts):
                part = texts.slice(a, b - a)
                counts, letters = subwords(part)
                known = letters & part.is_valid().to_numpy(zero_copy_only=False) & (model is not None)
                langs, best = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                if known.any():
                    scores = model.scores(_means(counts[known]))
                    langs[known], best[known] = np.array(model.langs, object)[scores.argmax(1)], scores.max(1)
                accepted = known & (best >= (model.least if model else 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(best), pa.array(accepted)], [*names, "lang_pred", "score", "accepted"])

    return given.mapInArrow(run, f"{fields}lang_pred string, score double, accepted boolean").toDF(*keep, "lang_pred", "score", "accepted")


def known(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns, whatever the names of these."""
    out = predict(docs, model, text, *docs.columns)
    numbered = out.toDF(*[f"c{i}" for i in range(len(out.columns) - 3)], "lang_pred", "score", "accepted")
    return numbered.where("accepted").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def identify(docs: DataFrame, sample: int = 3000, key: str = "doc_id") -> DataFrame:
    """``(key, held_out, lang_pred, score, accepted)`` of every row, by a model of the rows that aren't held out."""
    model = train(docs, sample, key=key)
    return predict(docs, model, "text", key).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "accepted")
