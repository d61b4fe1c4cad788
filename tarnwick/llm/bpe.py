"""Byte-level BPE encoding and decoding by a rank file.

Whole pre-tokens are looked up in a minimal perfect hash over the vocabulary; those that are not in it are
merged by a heap over linked bytes. Each different pre-token goes through this once, as long as a worker
remembers it. Everything runs per Arrow batch inside the tasks, in slices of bounded bytes; the vocabulary (a
fixed file of some 50,000 tokens) is the only thing sent to the executors.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import mix, slices, span_hashes

#: Bytes of text that one step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 21
#: Pre-tokens, and characters of them, whose ids a Python worker remembers for a vocabulary before it starts anew.
MEMO, MEMO_CHARACTERS = 300_000, 1 << 24
_memos: dict[int, "Memo"] = {}


class Memo:
    """Pre-tokens by number, and the ids of all of them end to end."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.characters = 0
        self.ids, self.first, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.characters += sum(map(len, pieces))
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])


class PerfectHash:
    """Minimal perfect hash by displacement: n keys to the slots 0 to n - 1, each key to its own."""

    def __init__(self, hashes: np.ndarray, per_bucket: int = 4):
        n = len(hashes)
        self.n, self.buckets = n, max(1, n // per_bucket)
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        tries = np.arange(1, 257, dtype=np.uint64)[:, None]
        for b in by_size[sizes[by_size] > 1]:
            keys = hashes[order[firsts[b] : firsts[b + 1]]]
            base = np.uint64(0)
            while True:
                slots = mix(keys[None, :] + (tries + base) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)
                ok = ~taken[slots.astype(np.int64)].any(1)
                if len(keys) > 1:
                    s = np.sort(slots, 1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(1)
                if ok.any():
                    k = int(np.argmax(ok))
                    self.shift[b] = int(base) + k + 1
                    taken[slots[k].astype(np.int64)] = True
                    break
                base += np.uint64(256)
        free = np.flatnonzero(~taken)
        single = by_size[sizes[by_size] == 1]
        self.shift[single] = -1 - free[: len(single)]

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shift[((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        moved = mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair with the least rank (then the leftmost) is joined until none is left.

    The parts are a doubly linked list of byte positions. The heap holds pairs as whole numbers (rank, begin
    and end side by side); those that a join has changed are dropped when they come up.
    """
    n = len(piece)
    end = [*range(1, n + 1)]  # where the part that begins here ends; 0: no part begins here
    back = [*range(-1, n - 1)]
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    bits = n.bit_length()
    two, low = 2 * bits, (1 << bits) - 1
    heap = [r << two | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        pair = pop(heap)
        i, stop = pair >> bits & low, pair & low
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            back[stop] = i
            after = end[stop]
            if (r := get(piece[i:after])) is not None:
                push(heap, r << two | i << bits | after)
        before = back[i]
        if before >= 0 and (r := get(piece[before:stop])) is not None:
            push(heap, r << two | before << bits | stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """What a task needs to encode and decode; made once on the driver and sent to the Python workers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = sorted(ranks, key=ranks.get)
        keys = pa.array(tokens, pa.large_binary())
        hashes = self._hashes(keys)
        self.hash = PerfectHash(hashes)
        slot = self.hash.slot(hashes)
        order = np.empty(len(tokens), np.int64)
        order[slot] = np.arange(len(tokens))
        self.by_slot = keys.take(pa.array(order))
        self.id_of_slot = np.array([ranks[t] for t in tokens], np.int32)[order]
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.by_id = pa.array(by_id, pa.large_binary())
        self.mark = hash(self.by_slot.buffers()[2].to_pybytes())
        self.find = None

    @staticmethod
    def _hashes(keys: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
        body = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        at = offsets - offsets[0]
        return span_hashes(body, at[:-1], at[1:])

    def __getstate__(self):
        return self.__dict__ | {"find": None}

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, end to end, and how many each has."""
        slot = pa.array(self.hash.slot(self._hashes(pieces)))
        known = pc.equal(self.by_slot.take(slot), pieces).to_numpy(zero_copy_only=False)
        ids = self.id_of_slot[slot.to_numpy()]
        counts = np.ones(len(pieces), np.int64)
        missing = np.flatnonzero(~known)
        if not len(missing):
            return ids, counts
        merged = [heap_merge(piece, self.ranks) for piece in pieces.take(pa.array(missing)).to_pylist()]
        own = np.fromiter(map(len, merged), np.int64, len(merged))
        counts[missing] = own
        out = np.empty(int(counts.sum()), np.int32)
        first = np.cumsum(counts) - counts
        out[first[known]] = ids[known]
        flat = np.fromiter(itertools.chain.from_iterable(merged), np.int32, int(own.sum()))
        out[np.repeat(first[missing] - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
        return out, counts

    def _numbers(self, flat: list[str]) -> tuple["Memo", np.ndarray]:
        """The number of each pre-token in this worker's memory, which now holds them all."""
        memo = _memos.get(self.mark)
        if memo is None or len(memo.number) > MEMO or memo.characters > MEMO_CHARACTERS:
            memo = _memos[self.mark] = Memo()
        new = list(set(flat).difference(memo.number))
        if new:
            memo.add(new, *self._ids(pa.array(new, pa.large_string()).cast(pa.large_binary())))
        return memo, np.fromiter(map(memo.number.__getitem__, flat), np.int64, len(flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, end to end, and the offsets of each text's ids."""
        if self.find is None:
            import regex

            self.find = regex.compile(self.pattern).findall
        flat: list[str] = []
        upto = [0]
        for text in texts:
            flat += self.find(text)
            upto.append(len(flat))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        memo, codes = self._numbers(flat)
        each = memo.counts[codes]
        ends = np.cumsum(each)
        out = memo.ids[np.repeat(memo.first[codes] - (ends - each), each) + np.arange(int(ends[-1]))]
        return out, np.concatenate([[0], ends])[np.array(upto)]

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """Bytes of each text: those of its tokens, end to end."""
        tokens = self.by_id.take(ids)
        at = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][offsets]
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), tokens.buffers()[2]]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", key: str = "doc_id", and_decode: bool = False) -> DataFrame:
    """``(key, ids array<int>)``: the ids of every whole text; ``and_decode`` also ``decoded``, as :func:`decode` makes it, in the same worker.

    ``vocabulary`` is the path of a rank file, read on the driver; ``pattern`` splits a text into pre-tokens,
    each of which is encoded by itself. Special tokens are ordinary text. A null or empty text has no ids. Rows
    are kept as they are, repeated or null keys too; other columns are left out.
    """
    coder = Encoder(read_ranks(vocabulary), pattern)

    def run(batches):
        for batch in batches:
            texts, keys = batch.column(1).fill_null(""), batch.column(0)
            for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), STEP_BYTES):
                ids, offsets = coder.encode(texts.slice(a, b - a).to_pylist())
                ids = pa.array(ids, pa.int32())
                out = [keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)]
                yield pa.RecordBatch.from_arrays([*out, coder.decode(ids, offsets)] if and_decode else out, names)

    names = ["k", "ids", "decoded"] if and_decode else ["k", "ids"]
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>" + ", decoded binary" * and_decode).toDF(key, *names[1:])


def decode(encoded: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``(key, ids, decoded binary)``: the bytes that the ids stand for. Null ids, or none: no bytes. An id that the vocabulary lacks raises an error."""
    coder = Encoder(read_ranks(vocabulary), pattern)

    def run(batches):
        for batch in batches:
            ids = batch.column(1)
            lengths = np.nan_to_num(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in slices(lengths, STEP_BYTES // 4):
                part = ids.slice(a, b - a)
                offsets = np.concatenate([[0], np.cumsum(lengths[a:b])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, coder.decode(part.flatten(), offsets)], ["k", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("k"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"k {kind}, ids array<int>, decoded binary").toDF(key, "ids", "decoded")


def digests(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text, the round trip in short; ``with_ids`` also ``ids``."""
    out = encode(docs, vocabulary, pattern, and_decode=True)
    return out.select(
        "doc_id",
        *["ids"] * with_ids,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
