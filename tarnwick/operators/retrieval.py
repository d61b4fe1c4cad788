"""Retrieval for many queries at once: BM25 over postings, exact vector search by cells, fusion, reranking, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import tokens
from ..functions.lineage import cut, few
from . import lexical_index, text as text_ops, text_index, vector_index


def bm25_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings ``(key, token, tf)``, lengths ``(key, length)`` and document frequencies ``(token, df, tf)``; a chunk without tokens has length 0."""
    postings = text_ops.term_counts(chunks, key, text)
    return postings, _lengths(chunks, key, text), postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _lengths(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return chunks.select(F.col(key), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("length"))


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int = 10, key: str = "chunk_id", text: str = "text", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """``(query_key, key, score, rank)``: the ``k`` best chunks of each query with a score over 0, ties by key. Repeated query words count again. Blocks of chunks that cannot reach the k-th are not read."""
    asked = few(lexical_index.wanted(queries, query_key, query).select("token").distinct())
    postings = cut(text_ops.term_counts_of(chunks, key, text, asked))
    frequencies = postings.groupBy("token").agg(F.count("*").alias("df"))  # all chunks of these tokens are there
    return lexical_index.search(queries, postings, _lengths(chunks, key, text), frequencies, k, key, query_key, query)


vector_search = vector_index.search


def rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 10, weight: float = 0.5, key: str = "chunk_id", query_key: str = "query_id") -> DataFrame:
    """``(query_key, key, dense_rank, bm25_rank, rrf, rank)``: ``weight`` / (60 + rank) of both lists, ties by key."""
    on = [query_key, key]
    both = dense.select(*on, F.col("rank").alias("dense_rank")).join(sparse.select(*on, F.col("rank").alias("bm25_rank")), on, "full_outer")
    part = lambda c, w: F.coalesce(w / (60 + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("dense_rank", weight) + part("bm25_rank", 1 - weight), 8))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("rrf"), key))).where(F.col("rank") <= k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 10, key: str = "chunk_id", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """The twice ``k`` best of both searches, fused."""
    embedded = cut(text_ops.embed(chunks, key, "text"))
    asked = text_ops.embed(queries, query_key, query)
    return rank_fusion(vector_search(asked, embedded, 2 * k, key, query_key=query_key), bm25_search(queries, chunks, 2 * k, key, query_key=query_key, query=query), k, key=key, query_key=query_key)


def rewrite(query: Column) -> Column:
    return F.regexp_replace(F.trim(query), r"[?!.]+$", "")


def rerank(candidates: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """``(query_key, key, rerank_score, rank)`` of ``(query_key, key, query, score, text, section)``: 0.40 score + 0.35 share of the query's words over two letters found (0.5 without such) + 0.15 (0.35 if a query of several words stands whole) + 0.10 (0.15 if a word stands in the section's title)."""
    q, body = F.lower("query"), F.lower("text")
    terms = F.filter(F.split(q, r"\s+"), lambda t: F.length(t) > 2)
    hits = F.size(F.filter(terms, lambda t: F.contains(body, t)))
    cover = F.when(F.size(terms) == 0, 0.5).otherwise(hits / F.size(terms))
    phrase = F.when((F.size(F.split(F.trim(q), r"\s+")) > 1) & F.contains(body, F.trim(q)), 0.35).otherwise(0.0)
    title = F.when(F.exists(terms, lambda t: F.contains(F.lower("section"), t)), 0.15).otherwise(0.0)
    scored = candidates.withColumn("rerank_score", F.round(0.40 * F.col("score") + 0.35 * cover + 0.15 * phrase + 0.10 * title, 6))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("rerank_score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(query_key, key, "rerank_score", "rank")


def retrieve_evidence(queries: DataFrame, chunks: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "chunk_id", query: str = "query") -> DataFrame:
    """Rewritten queries, hybrid search for three times ``k``, reranked to ``k``."""
    asked = queries.select(F.col(query_key), rewrite(F.col(query)).alias("query"))
    fused = hybrid_search(asked, chunks, 3 * k, key, query_key)
    found = chunks.select(key, "text", "section").join(few(fused.join(asked, query_key)), key).withColumn("score", F.col("rrf"))
    return rerank(found, k, query_key, key)


def citations(evidence: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, citation, snippet, confidence)`` of ``(query_id, chunk_id, filename, page, section, text, score)``; snippets of 200 characters."""
    label = F.concat(F.lit("Document: "), F.coalesce("filename", F.lit("unknown")), F.lit(", Page "), F.coalesce(F.col("page").cast("string"), F.lit("1")), F.when(F.col("section").isNotNull() & (F.col("section") != ""), F.concat(F.lit(", Section: "), F.col("section"))).otherwise(""))
    snippet = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return evidence.select("query_id", "chunk_id", label.alias("citation"), snippet.alias("snippet"), F.round("score", 4).alias("confidence"))


def answers(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """``(query_id, answer, grounded, citations)``: snippets by confidence, then chunk; no evidence is not grounded."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "chunk_id", "snippet"))), lambda x: x["snippet"])
    by = cited.groupBy("query_id").agg(F.array_join(lines, "\n").alias("answer"), F.count("*").alias("citations"))
    return queries.select("query_id").join(by, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.col("answer").isNotNull().alias("grounded"), F.coalesce("citations", F.lit(0)).alias("citations"))


def index_documents(docs: DataFrame, path: str, key: str, text: str, batch: str = "1", deleted: DataFrame | None = None) -> text_index.TextIndex:
    """Take ``docs`` into the index under ``path``, as the batch of that name: sections, chunks, tokens and embeddings in one go. Documents replace those of the same key; ``deleted(key)`` are forgotten; a batch that counts already changes nothing."""
    index = text_index.TextIndex(docs.sparkSession, path, key, docs.schema[key].dataType.simpleString())
    index.commit(batch, docs, deleted, text)
    index.tidy()
    return index
