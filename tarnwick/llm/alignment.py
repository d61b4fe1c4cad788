"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

A tokenizer's tokens and the bytes they cover are a sparse 0/1 matrix A (tokens by bytes) in compressed rows;
B is the other's. Gustavson's product A·Bᵀ, row by row, links tokens that overlap, with the bytes they share;
the product over the last bytes alone links tokens that end together. Places where tokens of both end cut a text
into groups; the product of the two token-by-group matrices links tokens of one group.

Everything is made per Arrow batch inside the tasks. How often a pair of ids is linked is counted over all texts:
tokens that end together are one the suffix of the other, so the pairs that can occur are known from the vocabularies
alone, and a count for each is a table of fixed size whatever the texts are.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint_dir, slices

#: Bytes of text that one step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
_loaded: dict[str, object] = {}


@dataclass
class Rows:
    """A sparse 0/1 matrix in compressed rows: row i holds the columns ``at[first[i]:first[i + 1]]``."""

    first: np.ndarray
    at: np.ndarray
    width: int

    def transposed(self) -> "Rows":
        order = np.argsort(self.at, kind="stable")
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        counts = np.bincount(self.at, minlength=self.width)
        return Rows(np.concatenate([[0], np.cumsum(counts)]), row[order], len(self.first) - 1)

    def times(self, other: "Rows") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gustavson's product: for each entry (i, k) row k of ``other`` is added to row i. Returns rows, columns and values of the entries, by row and column."""
        size = np.diff(other.first)[self.at]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        column = other.at[np.repeat(other.first[:-1][self.at] - (stop - size), size) + np.arange(total)]
        row = np.repeat(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), size)
        entry = row * other.width + column
        if total and (entry[1:] < entry[:-1]).any():
            entry = np.sort(entry)
        begin = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if total else np.zeros(0, np.int64)
        entry, value = entry[begin], np.diff(np.append(begin, total))
        return entry // max(other.width, 1), entry % max(other.width, 1), value


def incidence(ends: np.ndarray, n_bytes: int) -> Rows:
    """Tokens by the bytes they cover; a token begins where the one before it ends."""
    return Rows(np.concatenate([[0], ends]), np.arange(n_bytes), n_bytes)


def last_bytes(ends: np.ndarray, n_bytes: int) -> Rows:
    """Tokens by the last byte of each."""
    return Rows(np.arange(len(ends) + 1), ends - 1, n_bytes)


def groups(ends: np.ndarray, cuts: np.ndarray) -> Rows:
    """Tokens by the group they are in; ``cuts`` are the ends of the groups."""
    return Rows(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), len(cuts))


def links(kind: str, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked tokens of the two tokenizers, and what they share: ``overlap`` (bytes), ``end`` (the last byte) or ``group``. Both cover the same bytes."""
    n = int(ends_a[-1]) if len(ends_a) else 0
    if kind == "overlap":
        a, b = incidence(ends_a, n), incidence(ends_b, n)
    elif kind == "end":
        a, b = last_bytes(ends_a, n), last_bytes(ends_b, n)
    elif kind == "group":
        cuts = np.intersect1d(ends_a, ends_b, True)
        a, b = groups(ends_a, cuts), groups(ends_b, cuts)
    else:
        raise ValueError(f"no such kind of link: {kind}")
    return a.times(b.transposed())


class Tokenizer:
    """A public tokenizer from its file, read on the driver: byte-level BPE from ``.json``, pieces from ``.model``. ``prefix`` is put before a text that the tokenizer does not itself begin with a space."""

    def __init__(self, path: str, pattern: str = ""):
        with open(path, "rb") as file:
            self.body = file.read()
        self.kind, self.pattern = path.rsplit(".", 1)[1], pattern
        self.mark = hashlib.sha256(self.body + pattern.encode()).hexdigest()
        self.tokens = self._byte_level() if self.kind == "json" else self._pieces()
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def _byte_level(self) -> list[bytes]:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ids = json.loads(self.body)["model"]["vocab"]
        out = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if all(c in byte_of for c in token):
                out[i] = bytes(byte_of[c] for c in token)
        return out

    def _pieces(self) -> list[bytes]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.body)
        out = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece) if model.is_byte(i) else None
            special = model.is_control(i) or model.is_unknown(i)
            out.append(b"" if special else bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        return out

    def _library(self):
        """The library's own tokenizer, made once a worker."""
        if self.mark not in _loaded:
            if self.kind == "json":
                import tiktoken

                special = {e["content"] for e in json.loads(self.body)["added_tokens"]}
                ranks = {t: i for i, t in enumerate(self.tokens) if t and t.decode("latin1") not in special}
                _loaded[self.mark] = tiktoken.Encoding(self.mark, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            else:
                import sentencepiece

                _loaded[self.mark] = sentencepiece.SentencePieceProcessor(model_proto=self.body)
        return _loaded[self.mark]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, end to end, and where each text's begin: of a space and the text."""
        coder = self._library()
        each = [coder.encode_ordinary(" " + t) for t in texts] if self.kind == "json" else coder.encode(texts, num_threads=1)
        first = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        return np.fromiter(itertools.chain.from_iterable(each), np.int64, int(first[-1])), first

    def spelled(self) -> pa.Array:
        return pa.array(self.tokens, pa.large_binary())


@dataclass
class Aligned:
    """The tokens of the texts of one step, end to end: ids, last bytes, and where each text's begin. Texts without tokens have none."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    cuts: np.ndarray
    first_cut: np.ndarray


class Pair:
    """Two tokenizers side by side."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        self._spelled = None

    def __getstate__(self):
        return self.__dict__ | {"_spelled": None}

    def align(self, texts: list[str | None]) -> Aligned:
        """Encodes a space and each text by both; a text that is null, empty, or whose tokens do not spell it has none."""
        if self._spelled is None:
            self._spelled = self.a.spelled(), self.b.spelled()
        own = [t or "" for t in texts]
        want = [(b" " + t.encode()) if t else b"" for t in own]
        size = np.array([len(w) for w in want], np.int64)
        sides = []
        right = size > 0
        for coder, spelled in zip((self.a, self.b), self._spelled):
            ids, first = coder.encode(own)
            body = spelled.take(pa.array(ids))
            at = np.frombuffer(body.buffers()[1], np.int64)[body.offset :][first] if len(ids) else np.zeros(len(first), np.int64)
            data = memoryview(body.buffers()[2]).cast("B") if len(ids) else memoryview(b"")
            same = np.diff(at) == size
            for i in np.flatnonzero(same & right):
                same[i] = data[at[i] : at[i + 1]] == want[i]
            right &= same
            sides.append((coder, ids, first))
        found = []
        for coder, ids, first in sides:
            n = np.diff(first)
            ids = ids[np.repeat(right, n)]
            found += [ids, np.cumsum(coder.sizes[ids]), np.concatenate([[0], np.cumsum(np.where(right, n, 0))])]
        a, ends_a, first_a, b, ends_b, first_b = found
        cuts = np.intersect1d(ends_a, ends_b, True)
        stop = np.concatenate([[0], np.cumsum(np.where(right, size, 0))])
        return Aligned(a, b, ends_a, ends_b, first_a, first_b, cuts, np.searchsorted(cuts, stop, "right"))


def align(docs: DataFrame, a: Tokenizer, b: Tokenizer, kind: str = "overlap", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, a_ids, b_ids, a_groups, b_groups, links)`` for each row of ``docs``: the ids of its tokens by both tokenizers, the number of the group that each is in, and ``links`` as ``(a, b, shared)``, numbers of tokens from 0 and what they share (see :func:`links`).

    A text is encoded whole with a space before it, special tokens' strings as plain text. A text that is null, empty or
    whose tokens do not spell it by one of the two has no tokens. Repeated rows and those with a null key are kept.
    Other columns are left out.
    """
    pair = Pair(a, b)

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j in slices(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)), STEP_BYTES):
                got = pair.align(texts.slice(i, j - i).to_pylist())
                row, column, shared = links(kind, got.ends_a, got.ends_b)
                text_of = np.searchsorted(got.first_a, row, "right") - 1
                lists = lambda x, first: pa.ListArray.from_arrays(pa.array(first, pa.int32()), x)
                group = lambda ends, first: np.searchsorted(got.cuts, ends) - np.repeat(got.first_cut[:-1], np.diff(first))  # noqa: E731, B023
                out = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (row - got.first_a[text_of], column - got.first_b[text_of], shared)], ["a", "b", "shared"])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i)]
                    + [lists(pa.array(x, pa.int32()), first) for x, first in ((got.a, got.first_a), (got.b, got.first_b), (group(got.ends_a, got.first_a), got.first_a), (group(got.ends_b, got.first_b), got.first_b))]
                    + [lists(out, np.searchsorted(row, got.first_a))],
                    ["k", "a_ids", "b_ids", "a_groups", "b_groups", "links"],
                )

    ints = "a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, links array<struct<a: int, b: int, shared: int>>"
    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind_of_key}, {ints}").withColumnRenamed("k", key)


class EndPairs:
    """A slot for each pair of ids that can end together, one token's bytes being a suffix of the other's.

    A pair is told by its longer token and the shorter one's length, and by which of several ids of the same bytes
    each is; so there are fewer slots than bytes in both vocabularies, times the most ids that share their bytes.
    """

    def __init__(self, a: Tokenizer, b: Tokenizer):
        twin_a, twin_b = self._twin(a.tokens), self._twin(b.tokens)
        self.twins = int(max(twin_a.max(initial=0), twin_b.max(initial=0))) + 1
        self.twin = twin_a, twin_b
        self.sizes = a.sizes, b.sizes
        room = [np.concatenate([[0], np.cumsum(s * self.twins)]) for s in self.sizes]
        self.base = room[0][:-1], room[1][:-1] + room[0][-1]
        self.count = int(room[0][-1] + room[1][-1])

    @staticmethod
    def _twin(tokens: list[bytes]) -> np.ndarray:
        seen: dict[bytes, int] = {}
        out = np.zeros(len(tokens), np.int64)
        for i, token in enumerate(tokens):
            if token:
                out[i] = seen.get(token, 0)
                seen[token] = int(out[i]) + 1
        return out

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        na, nb = self.sizes[0][a], self.sizes[1][b]
        return np.where(nb <= na, self.base[0][a] + (nb - 1) * self.twins + self.twin[1][b], self.base[1][b] + (na - 1) * self.twins + self.twin[0][a])


class Speller:
    """Ids in decimal with the mark that follows each: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, a: int, b: int):
        texts = [f"{i}{mark}" for n, marks in ((a, ",|"), (b, ",;")) for mark in marks for i in range(n)]
        self.texts, self.a, self.b = pa.array(texts, pa.large_string()), a, b

    def digests(self, got: Aligned) -> list[str]:
        """For each text the hash of its groups, '' without tokens."""
        group_a, group_b = np.searchsorted(got.cuts, got.ends_a), np.searchsorted(got.cuts, got.ends_b)
        last_a, last_b = got.ends_a == got.cuts[group_a], got.ends_b == got.cuts[group_b]
        upto_a = np.searchsorted(group_a, np.arange(len(got.cuts) + 1))
        upto_b = np.searchsorted(group_b, np.arange(len(got.cuts) + 1))
        order = np.empty(len(got.a) + len(got.b), np.int64)
        order[np.arange(len(got.a)) + upto_b[group_a]] = got.a + np.where(last_a, self.a, 0)
        order[np.arange(len(got.b)) + upto_a[group_b + 1]] = got.b + 2 * self.a + np.where(last_b, self.b, 0)
        body = self.texts.take(pa.array(order))
        at = np.frombuffer(body.buffers()[1], np.int64)[body.offset :] if len(order) else np.zeros(1, np.int64)
        first = at[got.first_a + got.first_b]
        data = memoryview(body.buffers()[2]) if len(order) else memoryview(b"")
        return [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(first[:-1].tolist(), first[1:].tolist())]


def end_links(docs: DataFrame, a: Tokenizer, b: Tokenizer, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of ``docs``, from the links of kind ``end``.

    A pair of ids counts how many links over all rows hold it. ``n_best`` are the links whose pair has the highest count
    of its B id, ties included; ``count_sum`` adds up the counts of a row's links. ``groups_sha256`` hashes the groups,
    spelled by :class:`Speller`. A text without tokens (see :func:`align`) has zeros and ''. Repeated rows each count.

    Links stand as sorted slots of :class:`EndPairs` in a Parquet table in the shared folder, which whoever owns that
    folder may clear once the result is read; texts are encoded once. Counts are added up within each task, so a
    pair that is in every text is no hot key, and the counts that go to all tasks (:attr:`EndPairs.count` numbers, about
    a million for vocabularies of 50,000 and 32,000) are bounded by the vocabularies, not the texts.
    """
    pair, slots, speller = Pair(a, b), EndPairs(a, b), Speller(len(a.tokens), len(b.tokens))

    def encode(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j in slices(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)), STEP_BYTES):
                got = pair.align(texts.slice(i, j - i).to_pylist())
                row, column, _ = links("end", got.ends_a, got.ends_b)
                slot = slots.slot(got.a[row], got.b[column])
                first = np.searchsorted(row, got.first_a)
                own = np.repeat(np.arange(j - i), np.diff(first))
                slot = np.sort(own * slots.count + slot) - own * slots.count
                counts = [np.diff(x) for x in (got.first_a, got.first_b, got.first_cut)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), *[pa.array(c, pa.int64()) for c in counts], pa.array(speller.digests(got), pa.string()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(slot, pa.int32()))],
                    ["k", "n_a", "n_b", "n_groups", "groups_sha256", "slots"],
                )

    def count(batches):
        total = np.zeros(slots.count, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=slots.count)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["slot", "n"])

    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    rows.mapInArrow(encode, f"k {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, slots array<int>").write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    counted = stored.select("slots").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    times = np.zeros(slots.count, np.int64)
    times[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    # the B id of a slot: of the pairs told by an A token, the suffix's; those told by a B token, its own
    owner = _owners(slots, a, b)
    most = np.zeros(len(b.tokens) + 1, np.int64)
    np.maximum.at(most, owner, times)
    best = (times > 0) & (times == most[owner])

    def look_up(batches):
        for batch in batches:
            for i, j in slices(pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False), STEP_BYTES):
                part = batch.slice(i, j - i)
                slot = part.column(5).flatten().to_numpy()
                n = pc.list_value_length(part.column(5)).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[slot], dtype=np.int64)])[first]) for x in (best, times)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(4)], pa.array(n), *[pa.array(s) for s in sums], part.column(4)], ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return stored.mapInArrow(look_up, f"k {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").withColumnRenamed("k", key)


def _owners(slots: EndPairs, a: Tokenizer, b: Tokenizer) -> np.ndarray:
    """The B id of each slot; slots of no pair have the number after the last id."""
    out = np.full(slots.count, len(b.tokens), np.int64)
    by_bytes: dict[bytes, list[int]] = {}
    for i, token in enumerate(b.tokens):
        if token:
            by_bytes.setdefault(token, []).append(i)
    for i, token in enumerate(a.tokens):
        for n in range(1, len(token) + 1):
            for j in by_bytes.get(token[-n:], ()):
                out[slots.base[0][i] + (n - 1) * slots.twins + slots.twin[1][j]] = j
    own = np.repeat(np.arange(len(b.tokens)), slots.sizes[1] * slots.twins)
    out[slots.base[1][0] :] = own
    return out
