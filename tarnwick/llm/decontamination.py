"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment of words.

Each test item is seeded by its rarer word pairs, rarity being the number of training texts that hold one; a
pair may have one word between its two, in the item and in the text. Of any alignment that reaches the least
score so many matched words are that close to the next one that a fixed count of seeds must stand near each
other (see :class:`Items`); only there are words aligned with the item's, and no such alignment is lost. The
score is the best local alignment's over that of a full match, so edited and paraphrased copies score in part.
Items are a query set against all texts, in blocks of bounded size; texts are not shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import cut, mix, slices, span_hashes, spans, utf8

#: Points for a match, a mismatch and a gap; the bounds of :class:`Items` hold for these.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Test items sent to the tasks at once, by their words.
BLOCK_WORDS = 1_000_000
STEP_BYTES = 1 << 19
#: Cells of the alignments that are filled side by side.
CELLS = 1 << 21
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of ASCII letters and digits and of all other scripts' bytes), each text's first word, byte starts and ends of the words and first byte of each text."""
    data, offsets = utf8(pc.utf8_lower(texts))
    starts, ends, first = spans(data, offsets, _WORD)
    return span_hashes(data, starts, ends), first, starts, ends, offsets


def pairs(hashes: np.ndarray, first: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word with the next of its text and with the one after that (and, if ``single``, of the word alone), the place of the word and its text."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(hashes))
    out, at = [], []
    for k in (1, 2):
        i = place[place + k < first[1:][row]]
        out.append(mix(hashes[i] * np.uint64(0x9E3779B97F4A7C15) + hashes[i + k]))
        at.append(i)
    if single:
        out.append(mix(hashes ^ np.uint64(0x243F6A8885A308D3)))
        at.append(place)
    at = np.concatenate(at)
    return np.concatenate(out), at, row[at]


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each ``a[i]`` with ``b[i]``: its points and where it ends in each (the last word's place). Of equal ones the first by the end in a, then in b."""
    n, wide = len(a), max((len(x) for x in b), default=0)
    long = max((len(x) for x in a), default=0)
    left, right = np.zeros((n, long), np.uint64), np.ones((n, wide), np.uint64)
    used_a, used_b = np.zeros((n, long), bool), np.zeros((n, wide), bool)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
        used_a[i, : len(x)], used_b[i, : len(y)] = True, True
    best, end_a, end_b = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    above = np.zeros((n, wide + 1), np.int32)
    slope = -GAP * np.arange(wide + 1, dtype=np.int32)
    for i in range(long):
        same = (right == left[:, i : i + 1]) & used_b
        row = np.zeros_like(above)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row[:, 1:][~used_b] = 0
        row[~used_a[:, i]] = 0
        at = row.argmax(1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end_a[better], end_b[better] = top[better], i, at[better] - 1
        above = row
    return best, end_a, end_b


class Items:
    """A block of test items: their words and the places of their pairs.

    An alignment of m words with e mismatches and gaps has 2 m - e points. If that is 2 * ``least`` * n or more
    for an item of n words, then m >= least * n, e <= 2 (m - least * n), and the text's part has at most
    (3 - 2 * least) n words. Two or more errors stand between at most e / 2 neighbouring matches, so at least
    least * n - 1 places of the item begin a pair (with at most one word skipped on either side) that the text
    holds: ``bound``. Of short items, whose bound is under one pair, least * n single words are held.
    """

    def __init__(self, ids: list, texts: list[str | None], least: float):
        self.ids = ids
        hashes, first, *_ = words(pa.array(texts, pa.string()))
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        n = np.diff(first)
        enough = np.maximum(np.ceil(least * n - 1e-9).astype(np.int64), 1)
        alone = enough < 2
        self.single = bool((alone & (n > 0)).any())
        self.bound = np.where(alone, enough, enough - 1)
        self.wide = np.floor((3 - 2 * least) * n + 1e-9).astype(np.int64)
        gram, at, row = pairs(hashes, first, self.single)
        if self.single:
            own = np.arange(len(gram)) >= len(gram) - len(hashes)
            keep = own == alone[row]
            gram, at, row = gram[keep], at[keep], row[keep]
        order = np.lexsort((at, row, gram))
        self.gram, self.item, self.at = gram[order], row[order], (at - first[:-1][row])[order]
        self.seeds, self.group = np.unique(self.gram, return_inverse=True)
        self.close = self.bound
        self._filter()

    def _filter(self):
        """Where each seed's places begin, and a table of hash prefixes that most other n-grams fail."""
        self.begin = np.searchsorted(self.gram, self.seeds)
        self.count = np.diff(np.append(self.begin, len(self.gram)))
        self.table = np.zeros(1 << 20, bool)
        self.table[self.seeds >> np.uint64(44)] = True

    def rare(self, texts_with: np.ndarray) -> "Items":
        """The same items with the seeds of their rarer places, by the number of texts that hold each place's pairs.

        Pairs that no text holds are dropped, and with k = ``close`` the ``bound`` - k commonest places that are
        left: an alignment holds ``bound`` of these places, so k of the seeded ones. Items with fewer places are in no text.
        """
        n = texts_with[self.group]
        held = np.flatnonzero(n)
        size = np.array([len(w) for w in self.words], np.int64)
        base = np.cumsum(size) - size
        place = base[self.item[held]] + self.at[held]
        total = np.bincount(place, n[held], int(size.sum())).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        live = np.flatnonzero(total)
        live = live[np.lexsort((live, total[live], owner[live]))]
        have = np.bincount(owner[live], minlength=len(size))
        rank = np.arange(len(live)) - (np.cumsum(have) - have)[owner[live]]
        close = (self.bound + 1) // 2
        seeded = np.zeros(len(total), bool)
        seeded[live] = (rank < (have - (self.bound - close))[owner[live]]) & (have >= self.bound)[owner[live]]
        keep = held[seeded[place]]
        out = object.__new__(Items)
        out.ids, out.words, out.single, out.bound, out.wide, out.close = self.ids, self.words, self.single, self.bound, self.wide, close
        out.gram, out.item, out.at = self.gram[keep], self.item[keep], self.at[keep]
        out.seeds, out.group = np.unique(out.gram, return_inverse=True)
        out._filter()
        return out

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``gram`` that hold a seed, and which seed."""
        maybe = np.flatnonzero(self.table[gram >> np.uint64(44)])
        if not len(maybe) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.seeds, gram[maybe]), len(self.seeds) - 1)
        found = self.seeds[at] == gram[maybe]
        return maybe[found], at[found]


def _steps(batches):
    for batch in batches:
        texts = batch.column(1)
        for a, b in slices(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)), STEP_BYTES):
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)


def _counted(docs: DataFrame, items: Items) -> np.ndarray:
    """How many texts hold each seed."""

    def run(batches):
        total = np.zeros(len(items.seeds), np.int64)
        for _, texts in _steps(batches):
            hashes, first, *_ = words(texts)
            gram, _, row = pairs(hashes, first, items.single)
            at, seed = items.hits(gram)
            pair = np.unique(row[at] * np.int64(len(items.seeds) + 1) + seed)
            total += np.bincount(pair % (len(items.seeds) + 1), minlength=len(items.seeds))
        own = np.flatnonzero(total)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["seed", "n"])

    out = np.zeros(len(items.seeds), np.int64)
    found = docs.mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out[found["seed"].to_numpy()] = found["n"].to_numpy()
    return out


def _windows(items: Items, first: np.ndarray, at: np.ndarray, text: np.ndarray, seed: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(item, text, first word, end word)``: the parts of the texts around as many seeds of an item, close enough to each other, as an alignment must hold; parts that touch are one."""
    times = items.count[seed]
    entry = np.repeat(items.begin[seed] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    at, text, item = np.repeat(at, times), np.repeat(text, times), items.item[entry]
    order = np.lexsort((at, item))  # words go up with texts
    at, text, item = at[order], text[order], item[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (item[1:] != item[:-1])
    at, text, item = at[new], text[new], item[new]
    there = np.arange(len(at)) + items.close[item] - 1
    far = np.minimum(there, max(len(at) - 1, 0))
    wide = items.wide[item]
    ok = np.flatnonzero((there < len(at)) & (item[far] == item) & (text[far] == text) & (at[far] - at <= wide))
    item, text = item[ok], text[ok]
    low, high = np.maximum(at[far[ok]] - wide[ok], first[text]), np.minimum(at[ok] + wide[ok] + 1, first[text + 1])
    begin = np.ones(len(ok), bool)
    begin[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])
    begin = np.flatnonzero(begin)
    end = np.append(begin[1:], len(ok)) - 1 if len(ok) else begin
    return list(zip(item[begin].tolist(), text[begin].tolist(), low[begin].tolist(), high[end].tolist()))


def _found(items: Items, texts: pa.Array, least: float, places: bool = True):
    """``(text, item, score, first word, end word, first byte, end byte)`` of every alignment of ``least`` or more in an Arrow array of texts; without ``places`` only text and item, once for a part of a text."""
    sizes = np.array([len(w) for w in items.words], np.int64)
    hashes, first, starts, ends, offsets = words(texts)
    gram, at, row = pairs(hashes, first, items.single)
    place, seed = items.hits(gram)
    windows = _windows(items, first, at[place], row[place], seed)
    while windows:
        windows.sort(key=lambda w: w[3] - w[2])
        left = []
        for a, b in slices(np.array([sizes[w[0]] * (w[3] - w[2] + 1) for w in windows]), CELLS):
            part = windows[a:b]
            need = [items.words[w[0]] for w in part]
            have = [hashes[w[2] : w[3]] for w in part]
            points, end_a, end_b = align(need, have)
            good = [k for k in range(len(part)) if points[k] >= least * MATCH * len(need[k]) - 1e-9]
            if not places:
                yield from ((part[k][1], part[k][0]) for k in good)
                continue
            _, back_a, back_b = align([need[k][: end_a[k] + 1][::-1] for k in good], [have[k][: end_b[k] + 1][::-1] for k in good])
            for g, k in enumerate(good):
                i, t, s, e = part[k]
                last, start = s + int(end_b[k]), s + int(end_b[k]) - int(back_b[g])
                yield t, i, float(points[k]) / (MATCH * len(need[k])), start - int(first[t]), last - int(first[t]) + 1, int(starts[start] - offsets[t]), int(ends[last] - offsets[t])
                # other copies beside this one
                left += [(i, t, x, y) for x, y in ((s, start), (last + 1, e)) if y - x >= least * len(need[k])]
        windows = left


def _matched(docs: DataFrame, items: Items, least: float, kinds: tuple[str, str]) -> DataFrame:
    def run(batches):
        for keys, texts in _steps(batches):
            out = sorted(_found(items, texts, least))
            if out:
                t, i, score, w0, w1, b0, b1 = zip(*out)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(t)), pa.array([items.ids[x] for x in i]), pa.array(score), *(pa.array(x, pa.int64()) for x in (w0, w1, b0, b1))], ["k", "item", "score", "first_word", "end_word", "first_byte", "end_byte"])

    return docs.mapInArrow(run, f"k {kinds[0]}, item {kinds[1]}, score double, first_word bigint, end_word bigint, first_byte bigint, end_byte bigint")


def _blocks(given: DataFrame, benchmark: DataFrame, least: float, item: str, text: str):
    """The benchmark as :class:`Items` with seeds by their rarity in ``given(k, t)``, a block of about :data:`BLOCK_WORDS` words at a time."""
    ids: list = []
    texts: list[str] = []
    held = 0
    test = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("t")).where("t is not null")
    for row in test.orderBy("item").toLocalIterator():
        ids.append(row["item"])
        texts.append(row["t"])
        # a word and the white space behind it have two characters at least; items of long words close a block by their size
        held += max(len(re.findall(r"[^\x20\x09-\x0D]+", row["t"])), len(row["t"]) // 16, 1)
        if held >= BLOCK_WORDS:
            items = Items(ids, texts, least)
            yield items.rare(_counted(given, items))
            ids, texts, held = [], [], 0
    if ids:
        items = Items(ids, texts, least)
        yield items.rare(_counted(given, items))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``(key, item, score, first_word, end_word, first_byte, end_byte)``: where a text of ``docs`` holds a copy of a test item, edited or in part, with a score of ``least`` or more (1: word for word).

    Bytes are those of the lower-cased text. A text may match an item in several places, and several items.
    No such alignment is lost, so an item of one or two words matches every text that holds one of its words if
    ``least`` is 0.5 or less. Null or wordless texts and items match nothing; repeated rows each match, and so do rows
    with a null key; texts of any length are aligned whole around their seeds; other columns are left out. The
    benchmark is read to the driver in blocks of about a million words, each of which goes twice over all texts.
    """
    given = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kinds = (docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    out = given.sparkSession.createDataFrame([], f"k {kinds[0]}, item {kinds[1]}, score double, first_word bigint, end_word bigint, first_byte bigint, end_byte bigint")
    for items in _blocks(given, benchmark, least, item, text):
        out = out.union(_matched(given, items, least, kinds))
    return out.toDF(key, item, "score", "first_word", "end_word", "first_byte", "end_byte")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no test item, with all their columns.

    Each row is judged by its own text where it stands, so null and repeated keys make no difference and nothing
    is shuffled. Null and wordless texts stay. Rows that a block of the benchmark has left go on to the next
    through the shared folder.
    """
    given = docs.select(F.lit(None).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    schema, at = docs.schema, docs.columns.index(text)
    for number, items in enumerate(_blocks(given, benchmark, least, item, text)):

        def run(batches, items=items):
            for batch in batches:
                texts = batch.column(at).cast(pa.string())
                hit = np.zeros(len(batch), bool)
                for a, b in slices(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)), STEP_BYTES):
                    for t, _ in _found(items, texts.slice(a, b - a), least, places=False):
                        hit[a + t] = True
                yield batch.filter(pa.array(~hit)) if hit.any() else batch

        docs = (cut(docs) if number else docs).mapInArrow(run, schema)
    return docs
