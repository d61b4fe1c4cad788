"""Periodic runs of words by a dictionary of basic factors.

For each power of two L every stretch of L words gets a name, equal for equal stretches of one text: the names of
its two halves, sorted, tell it. A name that comes only once in a text ends there, so what is sorted shrinks
quickly. Where a name's next occurrence follows within 2 * L words and the one after at the same distance,
the three are an arithmetic progression and propose the distance as a period. The names then tell by halving
how far words that distance apart stay equal to the left and right. All texts of a step go through it at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import mix, slices, span_hashes, spans, utf8

#: Bytes of text that one step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def factors(words: np.ndarray, first: np.ndarray, proposals: list) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words that begin at each place; stretches of one text are equal where their names are. Adds ``(places, periods)`` to ``proposals`` for each length.

    ``words`` are the hashed words of all texts, ``first`` where each text begins. A stretch that does not
    come again in its text, or leaves it, has a negative name of its own.
    """
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    end = first[1:][text]
    alone = -1 - np.arange(len(words))
    places = np.arange(len(words))
    keys = mix(words ^ mix(text.astype(np.uint64) + np.uint64(1)))
    names, length = [], 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], places[order]
        again = keys[1:] == keys[:-1]
        repeated = np.zeros(len(at), bool)
        repeated[1:] |= again
        repeated[:-1] |= again
        name = np.cumsum(np.concatenate([[0], ~again]))
        own = alone.copy()
        own[at[repeated]] = name[repeated]
        names.append(own)
        gap = np.where(again, at[1:] - at[:-1], 0)
        near = (gap > 0) & (gap <= 2 * length)
        following = np.zeros(len(words), np.int64)
        following[at[:-1][near]] = gap[near]
        begin = np.flatnonzero(following)
        begin = begin[following[begin + following[begin]] == following[begin]]
        # of neighbouring places with one distance the first is enough
        chosen = np.zeros(len(words) + 1, np.int64)
        chosen[begin + 1] = following[begin]
        begin = begin[chosen[begin] != following[begin]]
        proposals.append((begin, following[begin]))
        places = np.sort(at[repeated])
        ahead = places + length
        # a period found by stretches of twice this length is over half of it, four periods fit in the text
        ok = (places + 2 * length <= end[places]) & (n[text[places]] > 4 * length)
        places, ahead = places[ok], ahead[ok]
        ok = own[ahead] >= 0
        places, ahead = places[ok], ahead[ok]
        keys = own[places] * (int(name[-1]) + 1 if len(name) else 1) + own[ahead]
        length *= 2
    return names


def find_runs(words: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, length, period)`` of all runs, by text, start and period; ``start`` counts from the text's first word. At least four periods make a run."""
    proposals: list[tuple[np.ndarray, np.ndarray]] = []
    names = factors(words, first, proposals)
    none = np.zeros(0, np.int64)
    at = np.concatenate([none, *[p[0] for p in proposals]])
    period = np.concatenate([none, *[p[1] for p in proposals]])
    text = np.searchsorted(first, at, "right") - 1
    begin, end = first[text], first[text + 1]
    right, left = at.copy(), at.copy()
    for k in reversed(range(len(names))):
        name, step = names[k], 1 << k
        while True:
            ok = np.flatnonzero(right + period + step <= end)
            ok = ok[name[right[ok]] == name[right[ok] + period[ok]]]
            right[ok] += step
            back = np.flatnonzero(left - step >= begin)
            back = back[name[left[back] - step] == name[left[back] - step + period[back]]]
            left[back] -= step
            if not len(ok) and not len(back):
                break
    length = right + period - left
    ok = (length >= least) & (length >= times * period)
    text, left, length, period = text[ok], left[ok], length[ok], period[ok]
    order = np.lexsort((period, length, left))
    text, left, length, period = text[order], left[order], length[order], period[order]
    # the same stretch by a multiple of its period
    fresh = np.ones(len(left), bool)
    fresh[1:] = (left[1:] != left[:-1]) | (length[1:] != length[:-1])
    text, left, length, period = text[fresh], left[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, left))
    return text[order], (left - first[text])[order], length[order], period[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts made of the words ``data[starts:ends]``, joined by one space; ``first`` tells each text's words."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    index = np.repeat(starts - (stop - size), size)
    index += np.arange(len(index))
    out = data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    upto = np.concatenate([[0], stop])[first]
    has = np.diff(first) > 0
    # the last space of each text goes
    drop = np.ones(len(out), bool)
    drop[upto[1:][has] - 1] = False
    offsets = upto - np.concatenate([[0], np.cumsum(has)])
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[drop].tobytes())]).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, text: str = "text", key: str = "doc_id", order: Callable | None = None) -> DataFrame:
    """``(key, n_words, runs, collapsed)`` for each row of ``docs``.

    Words are the stretches of the whole text without blanks and the bytes 9 to 13. ``runs`` are ``(start, length,
    period)``, by start and period: stretches of consecutive words whose smallest period is ``period``, of ``least``
    words and ``times`` periods at least (``times`` is 4 or more), that no neighbouring word
    extends. ``collapsed`` is the text with one space between words and without those words that some run contains
    after its first period. ``order(key, n)`` may give other places for the n words of a row, or None to leave them.

    A null, empty or blank text has no words and no runs; its ``collapsed`` is empty. Rows are judged each by itself,
    repeated ones and those with a null key too. Texts of any length are read whole. Other columns are left out.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).fill_null("")
            for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), STEP_BYTES):
                data, offsets = utf8(texts.slice(a, b - a))
                starts, ends, first = spans(data, offsets, _WORD)
                if order:
                    places = [order(k, n) if n else None for k, n in zip(keys.slice(a, b - a).to_pylist(), np.diff(first).tolist())]
                    if any(p is not None for p in places):
                        index = np.arange(len(starts))
                        for p, at in zip(places, first.tolist()):
                            if p is not None:
                                index[at : at + len(p)] = at + p
                        starts, ends = starts[index], ends[index]
                found, start, length, period = find_runs(span_hashes(data, starts, ends), first, least, times)
                lost = np.zeros(len(starts) + 1, np.int64)
                np.add.at(lost, first[found] + start + period, 1)
                np.add.at(lost, first[found] + start + length, -1)
                keep = np.cumsum(lost[:-1]) == 0
                kept = _joined(data, starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[first])
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                at = pa.array(np.searchsorted(found, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(at, runs), kept], ["k", "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, n_words bigint, runs array<{RUN}>, collapsed string").withColumnRenamed("k", key)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of what :func:`periodic_runs` returns: the run of the greatest length (ties: smallest start, then period; nulls without a run) and hashes of all runs and of the collapsed text."""
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    rows = found.select(F.col(key).alias("k_"), F.size("runs").cast("long").alias("n_runs"), most.alias("most_"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("most_.length"), -F.col("most_.period")
    return rows.select(
        F.col("k_").alias(key), "n_runs", (-F.col("most_.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("most_.length * 1000 div -most_.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
