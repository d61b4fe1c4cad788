"""Periodic runs, token links and repeated lines against brute force, and the defined results of odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tarnwick.llm import alignment, entries, lines, periods

WORD = r"[^\x20\x09-\x0D]+"
CLASHING = ("k", "t", "r", "w", "at", "n", "who", "h1", "h2", "line", "lost", "kept", "runs", "slots", "slot", "times", "k_", "most_")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark):
    """Nulls, empty and blank texts, a repeated row, a null key, a text of 200,000 words, and columns with names that operators use."""
    big = " ".join(f"w{i % 50_021}" for i in range(200_000)) + "\nThis line is found in every document."
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "Ünïcode çà 日本語 🙂 ▁ <s> <|endoftext|>\x00"), (6, big), (7, "x y x y x y x y\nthis LINE is found in every document.\t"), (7, "x y x y x y x y\nthis LINE is found in every document.\t"), (None, "this line is found in every document.\nthis line is found in every document."), (None, None), (8, "z" * 300_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})


# 11


def runs_by_force(words: list[str], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(w, len(number) + 1) for t in texts for w in t], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for text, *run in zip(*(x.tolist() for x in periods.find_runs(flat, first))):
        out[text].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_runs_of_small_alphabets(texts):
    assert runs_of(texts) == [runs_by_force(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=9), st.integers(1, 9)), min_size=1, max_size=5))
def test_runs_of_joined_powers(parts):
    text = [w for root, n in parts for w in root * n]
    assert runs_of([text, text[::-1]]) == [runs_by_force(text), runs_by_force(text[::-1])]


def test_runs_of_long_texts():
    rng = random.Random(5)
    fibonacci = ["a"]
    other = ["b"]
    while len(fibonacci) < 3000:
        fibonacci, other = fibonacci + other, fibonacci
    root = [str(rng.randrange(300)) for _ in range(170)]
    texts = [fibonacci, root * 7 + root[:11], ["one"] * 5000, [str(rng.randrange(4)) for _ in range(3000)], ["a", "b"] * 2, []]
    assert runs_of(texts) == [runs_by_force(t) for t in texts]


def collapsed_by_force(words, runs):
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def test_query_of_runs_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in entries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    changed = 0
    for d in docs:
        words = re.findall(WORD, d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = runs_by_force(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed_by_force(words, runs)))
        assert tuple(got[d["doc_id"]])[1:] == want
    assert changed


def test_runs_of_odd_texts(spark):
    df = odd(spark)
    for row in periods.periodic_runs(df.select("doc_id", "text", "k", "t", "runs")).collect():
        if row["doc_id"] in (1, 2, 3) or row["doc_id"] is None and not row["n_words"]:
            assert (row["n_words"], row["runs"], row["collapsed"]) == (0, [], "")
        elif row["doc_id"] == 7:
            assert ([tuple(r) for r in row["runs"]], row["collapsed"]) == ([(0, 8, 2)], "x y this LINE is found in every document.")
        elif row["doc_id"] == 6:
            assert (row["n_words"], row["runs"]) == (200_007, [])
    assert periods.digests(periods.periodic_runs(df)).count() == df.count()
    assert periods.digests(periods.periodic_runs(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(df, times=3)


# 12


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN), alignment.Tokenizer(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    """Encoders of the public libraries themselves, and the bytes of each id, made without the operator's tables."""
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        bytes_a = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def bytes_b(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    return (lambda t: coder.encode(" " + t, add_special_tokens=False).ids, bytes_a.get), (lambda t: pieces.encode(t), bytes_b)


def aligned_by_force(text, libraries):
    """Ids and ends of both tokenizers; none if either does not spell the text."""
    sides = []
    for encode, spelled in libraries:
        ids, ends, body = encode(text) if text else [], [], b""
        for i in ids:
            body += spelled(i)
            ends.append(len(body))
        if not text or body != b" " + text.encode():
            return [], [], [], []
        sides += [ids, ends]
    return sides


def test_query_of_links_by_brute_force(spark, libraries):
    """The whole query at the smallest size, against the libraries and loops over tokens."""
    _links_by_force(spark.read.parquet(f"{SF}/documents.parquet").collect(), entries.op12_token_alignment(spark, SF).collect(), libraries)


def _links_by_force(docs, got, libraries):
    whole, counts = [], Counter()
    for d in docs:
        a, ends_a, b, ends_b = aligned_by_force(d["text"], libraries)
        by_end = dict(zip(ends_b, b))
        links = [(i, by_end[e]) for i, e in zip(a, ends_a) if e in by_end]
        counts.update(links)
        parts, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            left, right = i, j
            while i < len(a) and ends_a[i] <= cut:
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                j += 1
            parts.append(",".join(map(str, a[left:i])) + "|" + ",".join(map(str, b[right:j])))
        whole.append((d["doc_id"], len(a), len(b), links, parts))
    most: dict[int, int] = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = [(k, na, nb, len(parts), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(parts)) if parts else "") for k, na, nb, links, parts in whole]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert sum(na > 0 for _, na, *_ in want) > len(want) / 2


def test_links_of_odd_texts(spark, tokenizers, libraries):
    df = odd(spark)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.end_links(df, *tokenizers)
    assert got.columns == names
    _links_by_force(df.collect(), got.collect(), libraries)
    none = alignment.end_links(df.where("doc_id in (1, 2)"), *tokenizers).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.end_links(df.limit(0), *tokenizers).collect() == []


@pytest.mark.parametrize("kind", ["overlap", "end", "group"])
def test_products_by_brute_force(spark, tokenizers, libraries, kind):
    """Links of all kinds, and groups, against loops over pairs of tokens."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 700).select("doc_id", "text")
    rows = {d["doc_id"]: d["text"] for d in docs.collect()}
    for r in alignment.align(docs, *tokenizers, kind).collect():
        a, ends_a, b, ends_b = aligned_by_force(rows[r["doc_id"]], libraries)
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        cuts = sorted(set(ends_a) & set(ends_b))
        group = lambda e: sum(c < e for c in cuts)  # noqa: E731, B023
        assert r["a_groups"] == [group(e) for e in ends_a] and r["b_groups"] == [group(e) for e in ends_b]
        want = []
        for i, e in enumerate(ends_a):
            for j, f in enumerate(ends_b):
                if kind == "end":
                    shared = int(e == f)
                elif kind == "group":
                    shared = int(r["a_groups"][i] == r["b_groups"][j])
                else:
                    shared = max(0, min(e, f) - max(([0] + ends_a)[i], ([0] + ends_b)[j]))
                if shared:
                    want.append((i, j, shared))
        assert [tuple(x) for x in r["links"]] == want


def test_code_points_split_alike(tokenizers, libraries):
    """The library that encodes by the ranks of the JSON file gives the ids of the one the file is made for, whatever code points stand together."""
    own, (other, _) = tokenizers[0], libraries[0]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 37] + list(range(0x3100)) + list(range(0x1F000, 0x1FB00))
    texts = [f"a{chr(c)}a 1{chr(c)}2 {chr(c)} {chr(c)}{chr(c)}1" for c in points]
    ids, first = own.encode(texts)
    assert all(ids[i:j].tolist() == other(t) for t, i, j in zip(texts, first[:-1], first[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), unique=True, max_size=4), max_size=6), st.lists(st.lists(st.integers(0, 7), unique=True, max_size=4), min_size=6, max_size=6))
def test_gustavson_equals_dense_product(left, right):
    make = lambda rows, width: alignment.Rows(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.array([c for r in rows for c in sorted(r)], np.int64), width)
    dense = lambda m: np.array([[int(c in m.at[i:j]) for c in range(m.width)] for i, j in zip(m.first[:-1], m.first[1:])]).reshape(len(m.first) - 1, m.width)
    a, b = make(left, 6), make(right, 8)
    out = np.zeros((len(left), 8), np.int64)
    row, column, value = a.times(b)
    out[row, column] = value
    assert (out == dense(a) @ dense(b)).all() and (dense(b.transposed()) == dense(b).T).all()
    assert (np.diff(row * 8 + column) > 0).all()


def test_slots_are_each_pairs_own():
    """Every pair of a token and a suffix has a slot that no other has, also where ids share their bytes."""

    class Fixed:
        def __init__(self, tokens):
            self.tokens, self.sizes = tokens, np.array([len(t) for t in tokens])

    a, b = Fixed([b"", b"a", b"ba", b"aba", b"ba", b"b"]), Fixed([b"a", b"a", b"", b"ba", b"cba", b"ccba"])
    slots = alignment.EndPairs(a, b)
    pairs = [(i, j) for i, x in enumerate(a.tokens) for j, y in enumerate(b.tokens) if x and y and (x.endswith(y) or y.endswith(x))]
    got = slots.slot(*np.array(pairs).T)
    assert len(set(got.tolist())) == len(pairs) and got.min() >= 0 and got.max() < slots.count
    assert alignment._owners(slots, a, b)[got].tolist() == [j for _, j in pairs]


# 13


def lines_by_force(rows, least=3, shortest=20):
    """``(key, kept, n_lines, n_dropped)``; rows have keys."""
    blanks, lower = " \t\n\x0b\x0c\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(blanks).translate(lower)
    held = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= shortest:
                held[key(line)].add(k)
    out = []
    for k, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(held[key(x)]) < least or k == max(held[key(x)])]
        out.append((k, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out)


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    kinds = ["A line that is in many documents", "a LINE that is in many documents", "\tA line that is in many documents\x0b ", "É line that is in many documents", "é line that is in many documents", "nineteen characters", "twenty characters!!!", "日本語" * 7, "", " "]
    rows = [(rng.randrange(60), "\n".join(rng.choice(kinds + [f"own line of this document {i}"]) for _ in range(rng.randrange(12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = lines.without_repeated_lines(df)
    assert got.columns == ["doc_id", "kept", "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.collect())) == lines_by_force(rows)
    for least, shortest in ((2, 1), (5, 19)):
        assert sorted(map(tuple, lines.without_repeated_lines(df, least, shortest).collect())) == lines_by_force(rows, least, shortest)


def test_lines_of_odd_texts(spark):
    """The line of four documents stays in the one with the largest doc_id only; documents without one come before all."""
    got = lines.without_repeated_lines(odd(spark)).collect()
    shown = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], len(r["kept"])) for r in got)
    assert shown == sorted([(0, 1, 0, 0), (0, 2, 2, 0), (1, 1, 0, 0), (2, 1, 0, 0), (3, 2, 0, 3), (4, 1, 0, 1), (5, 1, 0, 37), (6, 2, 1, len(" ".join(f"w{i % 50_021}" for i in range(200_000)))), (7, 2, 0, 54), (7, 2, 0, 54), (8, 1, 0, 300_000)])
    assert lines.without_repeated_lines(odd(spark).limit(0)).collect() == []


def test_a_line_in_every_document(spark):
    """One line that is twice in each of 3,000 documents, others in none but their own."""
    rows = [(i, f"own {i}\n{'the very same line of all'}\nTHE very same line of all ") for i in range(3000)]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("n_dropped <> 2").select("doc_id", "n_dropped").collect() == [(2999, 0)]
    assert got.where("kept = concat('own ', doc_id)").count() == 2999
