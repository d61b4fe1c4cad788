"""Indexes of substrings, tokens and vectors against plain scans; an index maintained over batches against one built anew."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tarnwick.functions import folders
from tarnwick.functions.lineage import cut
from tarnwick.functions.substrings import containing
from tarnwick.operators import explore, graph, lexical_index, retrieval, text, text_index, vector_index
from tarnwick.plans import catalog

QUERIES = catalog.queries()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# substrings


def test_substrings_by_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    texts = [(i, word(rng.randrange(12))) for i in range(300)] + [(300, None), (301, "")]
    words = [word(rng.randrange(6)) for _ in range(80)] + ["", "zzz", "abz", None, "%a", texts[0][1]]
    got = containing(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame([(w,) for w in words], "w string"), "w")
    assert got.columns == ["k", "w"]
    assert rows(got) == sorted({(k, w) for k, t in texts if t is not None for w in words if w is not None and w in t}, key=repr)


def test_no_nested_loops(spark):
    """The three queries that look for words in names: no join without equal keys."""
    for name in ("graph_search", "mention_join", "claim_metric_join"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # a scalar of one row may be broadcast, a loop that compares texts may not
        assert not [p for p in plan.split("\n") if "NestedLoop" in p and "contains" in p.lower()], name
    names = spark.createDataFrame([("a", "one two three four five six"), ("b", "two three four five seven"), ("c", "six")], "id string, name string")
    docs = spark.createDataFrame([(1, "Well: one two, three four five six!"), (2, "two three four five sixes"), (3, None)], "doc_id long, text string")
    found = graph.mentions(docs, names, "doc_id", "text")
    assert rows(found) == [(1, "a"), (1, "c")] and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_claims_of_empty_names(spark):
    claims = spark.createDataFrame([("b", "1", "", 1.0), ("b", "2", "Total", 1.0), ("b", "3", "my total cost", 1.0), ("b", "4", None, 1.0)], "batch string, claim_id string, name string, claimed double")
    metrics = spark.createDataFrame([("total", 5.0), ("cost", 6.0)], "metric string, value double")
    assert {r["claim_id"]: r["actual"] for r in explore.match_claims(claims, metrics).collect()} == {"1": 6.0, "2": 5.0, "3": 6.0, "4": None}


# tokens


def test_blocks_that_cannot_win_are_not_read(spark):
    """Equal to adding up all postings of the documents, with less than all of them read."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    postings, lengths, frequencies = retrieval.bm25_index(docs)
    asked = lexical_index.wanted(queries)
    hits = lexical_index.impacts(postings, lengths, frequencies, block=16).cache()
    every = lexical_index.bounds(hits, asked)
    plain = lexical_index.best(lexical_index.scores(hits, asked, every), 3)
    got = lexical_index.search(queries, postings, lengths, frequencies, 3, block=16)
    assert rows(got) == rows(plain.select(*got.columns))
    floor = plain.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    read = every.join(floor, "query_id").where((F.col("place") <= lexical_index.FIRST) | (F.col("n") < 3) | (F.col("bound") + lexical_index.ROOM >= F.col("floor")))
    of = lambda blocks: hits.join(blocks.select("query_id", "block"), "block").join(asked, ["query_id", "token"]).count()
    share = of(read) / of(every)
    assert share < 0.75, share
    # no chunk scores more than its block's bound
    assert lexical_index.scores(hits, asked, every).join(hits.select("chunk_id", "block").distinct(), "chunk_id").join(every, ["query_id", "block"]).where(F.col("score") > F.col("bound") + 1e-5).isEmpty()
    hits.unpersist()


def test_blocks_are_added_up_where_they_lie(spark, monkeypatch):
    """Equal to the sums over all postings: ties at the k-th place, few queries at once, and no rows but the best of a block leave it."""
    monkeypatch.setattr(lexical_index, "ASKED", 3)
    rng = random.Random(5)
    line = lambda: " ".join(rng.choices(["red", "green", "blue", "black", "white", "grey"], k=rng.choice([3, 3, 9])))
    chunks = spark.createDataFrame([(f"c{i}", line()) for i in range(300)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, line()) for i in range(7)], "query_id long, query string")
    postings, lengths, frequencies = retrieval.bm25_index(chunks)
    asked = cut(lexical_index.wanted(queries))
    hits = cut(lexical_index.impacts(postings, lengths, frequencies, block=16))
    every = cut(lexical_index.bounds(hits, asked))
    plain = cut(lexical_index.scores(hits, asked, every))
    few = cut(lexical_index.leaders(hits, asked, every, 3))
    assert rows(lexical_index.best(few, 3)) == rows(lexical_index.best(plain, 3))
    assert few.count() < plain.count() / 2


def test_tokens_are_counted_where_a_text_lies(spark):
    """Only the counts of keys that come again are shuffled, and only words that are asked for."""
    texts = [(1, "a b-c b-c -b-c- the x"), (2, None), (3, ""), (None, "two two"), (4, "\u00e9t\u00e9 ok2 OK2")]
    unique = spark.createDataFrame(texts, "k long, text string")
    want = [(1, "b-c", 3), (4, "ok2", 2), (None, "two", 2)]
    counted = text.term_counts(unique, "k", "text")
    assert rows(counted) == sorted(want, key=repr)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    again = text.term_counts(unique.unionAll(spark.createDataFrame([(4, "ok2 more"), (None, "two")], unique.schema)), "k", "text")
    assert rows(again) == sorted([(1, "b-c", 3), (4, "ok2", 3), (4, "more", 1), (None, "two", 3)], key=repr)
    of = text.term_counts_of(unique, "k", "text", spark.createDataFrame([("ok2",), ("b-c",), ("none",)], "token string"))
    assert rows(of) == [(1, "b-c", 3), (4, "ok2", 2)]


def test_search_without_rows(spark):
    chunks = spark.createDataFrame([("a", "some words"), ("b", None)], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "words words"), (2, None), (3, "other")], "query_id long, query string")
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieval.bm25_search(queries, chunks).collect()] == [(1, "a", 1)]
    assert retrieval.bm25_search(queries.limit(0), chunks).collect() == retrieval.bm25_search(queries, chunks.limit(0)).collect() == []


# vectors


def nearest_by_force(queries, corpus, k):
    unit = lambda v: np.zeros(len(v)) if np.linalg.norm(v) < 1e-6 else np.array(v) / np.linalg.norm(v)
    out = []
    for q, v in queries:
        if v is not None:
            scored = sorted((-round(float(unit(v) @ unit(w)), 6), c) for c, w in corpus if w is not None)[:k]
            out += [(q, c, -s + 0.0, i + 1) for i, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("pivots, tile, block", [(1, 10, 7), (12, 40, 3), (256, 4096, 2048)])
def test_vectors_by_brute_force(spark, monkeypatch, pivots, tile, block):
    """Clusters, copies, vectors of length 0 and nulls on both sides; tiles and blocks of a few rows."""
    monkeypatch.setattr(vector_index, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 4
    corpus = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(30)] + [(400, [0.0] * 8), (401, [0.0] * 8), (402, None)]
    queries = [(i, (centres[i % 6] * (1 if i % 3 else -1) + rng.normal(size=8)).tolist()) for i in range(20)] + [(50, [0.0] * 8), (51, None), (52, [1.0] * 8)]
    c, q = spark.createDataFrame(corpus, "chunk_id long, vector array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = vector_index.search(q, c, 5, pivots=pivots, tile=tile)
    assert sorted((r[0], r[1], r[2] + 0.0, r[3]) for r in got.collect()) == nearest_by_force(queries, corpus, 5)
    assert vector_index.search(q.limit(0), c, 5).collect() == vector_index.search(q, c.limit(0), 5).collect() == []


def test_cells_are_skipped(spark):
    """Well apart clusters: a query looks into its own."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    corpus = spark.createDataFrame([(i, (centres[i % 40] + 0.02 * rng.normal(size=16)).tolist()) for i in range(2000)], "c long, v array<double>")
    queries = spark.createDataFrame([(i, centres[i].tolist(), 0.99) for i in range(40)], "q long, v array<double>, least double")
    cells = vector_index.Cells(corpus)
    visits = cells.visits(queries, 10, False).union(cells.visits(queries, 10, True)).groupBy("cell").count().collect()
    assert sum(r["count"] * int(cells.count[r["cell"]]) for r in visits) < 0.2 * 40 * 2000


def test_queries_are_not_repeated_for_their_cells_in_python(spark):
    rng = np.random.default_rng(6)
    corpus = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(900)], "c long, v array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist(), -2.0) for i in range(50)], "q long, v array<double>, least double")
    cells = vector_index.Cells(corpus)
    rows = cells.choices(queries, 10, True).collect()
    assert len(rows) == 50 and sum(len(r["cells"]) for r in rows) > 50 * 20
    assert sorted((r["q"], c) for r in rows for c in r["cells"]) == sorted((r["q"], r["cell"]) for r in cells.visits(queries, 10, True).collect())


@pytest.mark.parametrize("k", [3, 500, 900])
def test_scores_of_a_tile_are_held_in_part(monkeypatch, k):
    import tracemalloc

    rng = np.random.default_rng(7)
    asks, rows = rng.integers(-2, 3, (400, 4)).astype(float), rng.integers(-2, 3, (800, 4)).astype(float)  # many ties
    s = asks @ rows.T
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    places, scores = vector_index.best_of(asks, rows, k)
    assert places[0].tolist() == np.repeat(np.arange(400), min(k, 800)).tolist() and places[1].tolist() == top.ravel().tolist()
    assert scores.tolist() == np.take_along_axis(s, top, 1).ravel().tolist()
    monkeypatch.setattr(vector_index, "PRODUCTS", 1 << 14)
    tracemalloc.start()
    vector_index.best_of(asks, rows, 3)
    assert tracemalloc.get_traced_memory()[1] < 400 * 800 * 8 / 2
    tracemalloc.stop()


def test_nothing_goes_through_the_driver_row_by_row():
    import inspect

    assert "toLocalIterator" not in inspect.getsource(vector_index) + inspect.getsource(retrieval) + inspect.getsource(lexical_index)


# the maintained index


def state(index):
    return rows(index.postings()), rows(index.lengths()), rows(index.frequencies()), rows(index.chunks())


@pytest.mark.parametrize("vectors", [False, True])
def test_batches_equal_a_rebuild(spark, tmp_path, vectors):
    """Inserts, replacements, deletions, replays, a batch that broke off, and merges: always what a rebuild gives."""
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) + str(rng.randrange(4)) for _ in range(n))
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    index = text_index.TextIndex(spark, str(tmp_path / "index"), chunker=text_index.whole_texts, vectors=vectors)
    queries = spark.createDataFrame([(1, "alpha1 beta2"), (2, "gamma3 gamma3 delta0"), (3, "nothing")], "query_id long, query string")
    docs: dict[int, str | None] = {}
    for n in range(3 if vectors else 6):
        new = {rng.randrange(40): (make(rng.randrange(9)) if rng.random() < 0.9 else None) for _ in range(15)}
        gone = {rng.randrange(40) for _ in range(5)}
        for again in range(2):
            assert index.commit(f"batch {n}", frame(new), spark.createDataFrame([(k,) for k in gone], "doc_id long")) is (not again)
        docs = {k: v for k, v in (docs | new).items() if k not in gone}
        if n == 1:
            # a folder without its list of batches does not count
            frame(new).write.parquet(f"{tmp_path}/index/{n + 2:012d}-{n + 2:012d}/gone")
        if n in (1, 4):
            index.merge(index.segments()[-2:])
        anew = text_index.TextIndex(spark, str(tmp_path / f"anew{n}"), chunker=text_index.whole_texts, vectors=vectors)
        anew.commit("all", frame(docs))
        assert state(index) == state(anew)
        assert rows(index.search(queries, 3)) == rows(anew.search(queries, 3))
        if vectors:
            assert rows(index.nearest(queries, 3)) == rows(anew.nearest(queries, 3))
    before = state(index)
    index.tidy(2)
    assert len(index.segments()) <= 2 and state(index) == before
    assert not index.commit("batch 0", frame({1: "x"})) and state(index) == before
    if not vectors:
        index.merge(index.segments()) if len(index.segments()) > 1 else None
        assert state(index) == before and index._read("gone", index.segments()).isEmpty()
        assert len(folders.listed(spark, str(tmp_path / "index"))) == 1


def test_index_of_odd_rows(spark, tmp_path):
    """A key twice in a batch, null keys, empty texts, an empty batch, and a first batch that only deletes."""
    index = text_index.TextIndex(spark, str(tmp_path / "odd"), chunker=text_index.whole_texts, vectors=False)
    assert index.segments() == [] and index.batches() == set()
    index.commit("none", deleted=spark.createDataFrame([(1,)], "doc_id long"))
    index.commit("odd", spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (None, "dd"), (2, ""), (3, None)], "doc_id long, text string"))
    index.commit("empty")
    assert rows(index.frequencies()) == [("aa", 1), ("cc", 1)] and rows(index.lengths()) == [(1, "1", 2), (2, "2", 0), (3, "3", 0)]


def test_commits_and_reads_shuffle_no_words(spark, tmp_path):
    """A chunk's words are one row, which tombstones meet where it lies; a first segment has none."""
    index = text_index.TextIndex(spark, str(tmp_path / "few"), chunker=text_index.whole_texts, vectors=False)
    index.commit("all", spark.createDataFrame([(i, f"aa -b-b- word{i} aa the") for i in range(20)], "doc_id long, text string"))
    plan = lambda: index.postings()._jdf.queryExecution().executedPlan().toString()
    assert index._read("gone", index.segments()).isEmpty() and "Exchange" not in plan()
    index.commit("some", spark.createDataFrame([(1, "new"), (1, "aa"), (None, "x"), (30, "aa")], "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long"))
    assert "BroadcastHashJoin" in plan() and "hashpartitioning" not in plan() and "Sort" not in plan()
    assert sorted(map(tuple, index._read("words", index.segments()[:1]).where("doc_id = 2").select("length", "terms").collect())) == [(4, [("aa", 2), ("b-b", 1), ("word2", 1)])]
    got = dict(map(tuple, index.frequencies().collect()))
    assert got["aa"] == 19 and got["new"] == 1 and "word2" not in got and "word1" not in got and got["b-b"] == 18
    assert "given" not in folders.listed(spark, f"{tmp_path}/few/{2:012d}-{2:012d}")


def test_indexed_documents_by_section(spark):
    """Both index queries hold each document once: the chunks and token counts of the documents at hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = text.chunks(text.text_sections(docs, "doc_id", "text"), "doc_id")
    want = text.term_counts(chunks, "chunk_id", "text").groupBy("token").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf")).withColumn("df", F.col("chunks"))
    for name in ("index_documents", "stream_index"):
        assert rows(QUERIES[name](spark, SF)) == rows(want)


def test_table_function_gives_the_same_chunks(spark):
    want = QUERIES["doc_chunks"](spark, SF)
    assert rows(QUERIES["doc_chunks_lateral"](spark, SF).select(*want.columns)) == rows(want)
    text.register(spark)
    got = spark.sql("SELECT * FROM doc_chunks('One two. Three four.\nFive', 2, 0)").collect()
    assert [tuple(r) for r in got] == [(0, "One two.", 2), (1, "Three four.", 2), (2, "Five", 1)]
    assert spark.sql("SELECT * FROM doc_chunks(CAST(NULL AS STRING), 2, 0)").collect() == []


# replay


def test_files_of_a_replay_go_in_the_order_of_time(spark, tmp_path):
    from tarnwick.plans import streams

    events = spark.read.parquet(f"{SF}/events.parquet").repartition(7)
    streams._written(events, str(tmp_path / "in"))
    files = sorted((f.stat().st_mtime, f.name) for f in (tmp_path / "in").glob("part-*"))
    assert len(files) >= 4 and len({m for m, _ in files}) == len(files)
    ends = [spark.read.parquet(str(tmp_path / "in" / name)).agg(F.min("ts"), F.max("ts")).first() for _, name in files]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:])) and Counter(n for _, n in files).most_common(1)[0][1] == 1


def test_hashed_embeddings_by_hand(spark):
    import hashlib
    import math
    import re

    from tarnwick.operators import text

    docs = [(1, "Ab abc, ABC! x_1"), (2, None), (3, "?"), (4, "word " * 45_000 + "q" * 300), (5, "one two"), (5, "two three"), (6, "solo")]
    out = text.embed(spark.createDataFrame(docs, "id int, t string").repartition(3), "id", "t", 100)
    # features of all texts as rows, each shuffled twice, made the work grow far beyond the texts
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for key, body in docs:
        w = re.findall("[a-z0-9_]+", (body or "").lower())
        made = [(x, 10) for x in w] + [(x[i : i + 3], 3) for x in w for i in range(len(x) - 2)] + [(f"{a}_{b}", 8) for a, b in zip(w, w[1:])]
        for f, v in made:
            at = want.setdefault(key, [0] * 100)
            at[int(hashlib.md5(f.encode()).hexdigest(), 16) % 100] += v
        want.setdefault(key, [0] * 100)
    got = {r["id"]: r["vector"] for r in out.collect()}
    assert got.keys() == want.keys()
    for key, v in want.items():
        length = math.sqrt(sum(x * x for x in v)) or 1
        assert max(abs(x / length - y) for x, y in zip(v, got[key])) < 1e-6


def counted(spark, df, column):
    """``df`` that counts how often a row's ``column`` is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def look(x):
        seen.add(1)
        return x

    return df.withColumn(column, look.asNondeterministic()(column)), seen


def test_grams_are_cut_up_once_and_by_all_tasks(spark):
    from tarnwick.functions import substrings

    names, seen = counted(spark, spark.createDataFrame([(i, f"name of {i}") for i in range(100)], "k long, t string").coalesce(1), "t")
    words = spark.createDataFrame([("name",), ("f 9",), ("zzz",)], "w string")
    got = substrings.containing(names, "k", "t", words, "w").collect()
    assert sorted((r["k"], r["w"]) for r in got) == sorted((i, w) for i in range(100) for w in ("name", "f 9") if w in f"name of {i}")
    assert seen.value <= 200  # the grams, and the look at the texts that were met


def test_a_question_searches_once(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"word{i}", "T", {"a": "b"}) for i in range(40)], "id string, name string, node_type string, properties map<string,string>")
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "R", 1.0, {"a": "b"}) for i in range(39)], "id string, source_id string, target_id string, relation string, weight double, properties map<string,string>")
    queries, seen = counted(spark, spark.createDataFrame([(1, "word3 word20")], "query_id long, query string"), "query")
    got = graph.question(nodes, edges, queries, 1, 2).collect()
    assert {r["content"] for r in got if r["kind"] == "entity"} == {"n20", "n3"} and any(r["kind"] == "fact" for r in got)
    assert seen.value <= 3


def test_questions_reach_two_hops_from_four_entities(spark):
    """``graph_query`` by force, with the reference's numbers of entities, hops, steps and paths."""
    from tarnwick.plans import base, graphs

    nodes = {r["id"]: r for r in graphs.nodes(spark, SF).collect()}
    edges = graphs.edges(spark, SF).collect()
    near, out = {}, {}
    for e in edges:
        near.setdefault(e["source_id"], set()).add(e["target_id"])
        near.setdefault(e["target_id"], set()).add(e["source_id"])
        out.setdefault(e["source_id"], set()).add(e["target_id"])
    want = []
    for q in base.derived(spark, SF, graphs._ASK).collect():
        score = Counter()
        for i, n in nodes.items():
            for w in q["query"].split():
                name, props = n["name"].lower(), '{"kind":"%s"}' % n["properties"]["kind"]
                score[i] += 5 if w == name else 2.5 if w in name else 1.5 if w in i else 1 if w in props else 0
        seeds = sorted((i for i in score if score[i]), key=lambda i: (-score[i], i))[:4]
        area = set(seeds)
        for _ in range(2):
            area |= {b for a in area for b in near.get(a, ())}
        want += [(q["query_id"], "entity", i) for i in seeds]
        want += [(q["query_id"], "fact", f"'{nodes[e['source_id']]['name']}' {e['relation']} '{nodes[e['target_id']]['name']}'.") for e in edges if {e["source_id"], e["target_id"]} <= area]
        for a in seeds:
            walks, found = [[a]], []
            for _ in range(3):
                walks = [w + [b] for w in walks for b in out.get(w[-1], ()) if b not in w]
                found += walks
            for b in seeds:
                want += [(q["query_id"], "path", " -> ".join(w)) for w in sorted((w for w in found if w[-1] == b), key=lambda w: (len(w), w))[:5]]
    assert Counter(map(tuple, QUERIES["graph_query"](spark, SF).collect())) == Counter(want) and {k for _, k, _ in want} == {"entity", "fact", "path"}


def test_few_rows_leave_a_large_side_unshuffled(spark):
    """Candidates go to the documents, so that no texts are shuffled for them."""
    plan = QUERIES["rerank_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "text" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(chunk_id" in x)


def test_ranks_by_force_in_many_parts(spark, monkeypatch):
    """Parallel links, links of weight 0, to nodes that aren't there, and nodes without links; parts hold a few rows."""
    from tarnwick.functions import lineage
    from tarnwick.plans import base, graphs

    monkeypatch.setattr(lineage, "PART", 7)
    assert lineage.even(spark.range(100), 100, "id").rdd.getNumPartitions() == 15
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(32)}", float(rng.randrange(4))) for _ in range(150)]
    names = [f"n{i}" for i in range(30)]
    got = dict(map(tuple, graph.pagerank(spark.createDataFrame([(x,) for x in names + names[:5]], "id string"), spark.createDataFrame(edges, "source_id string, target_id string, weight double"), tolerance=1e-12).collect()))
    links = Counter()
    for a, b, w in edges:
        if b in names and w:
            links[a, b] += w
    out = Counter()
    for (a, _), w in links.items():
        out[a] += w
    want = dict.fromkeys(names, 1 / 30)
    for _ in range(200):
        spread = sum(x for a, x in want.items() if not out[a]) / 30
        want = {b: 0.85 * (spread + sum(want[a] * w / out[a] for (a, t), w in links.items() if t == b)) + 0.15 / 30 for b in names}
    assert got == pytest.approx(want, abs=1e-9)
    # trade is added up by numbers, in as many parts as its lines need, and never sorted
    found = graphs.trade(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning(o_custkey" in plan and ", 4)" not in plan
    monkeypatch.undo()
    assert rows(graphs.trade(spark, SF)) == rows(base.derived(spark, SF, graphs._TRADE))
