"""Queries: sections, chunks, tokens, BM25, embeddings, vector and hybrid search, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import STOP_WORDS, cosine, tokens
from ..functions.lineage import few
from ..operators import retrieval, text
from ..operators.text_index import TextIndex, whole_texts
from .base import Section, derived, scratch, table

S = Section()
query = S.query


@query("doc_hash", "SELECT doc_id, sha256(text) AS sha, concat('doc_', substr(sha256(text), 1, 12)) AS name FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.doc_hash(F.col("text")).alias("sha"), text.doc_id(F.col("text")).alias("name"))


# conversations as documents: turns become paragraphs


def talks(spark, d) -> DataFrame:
    """One text a conversation, its turns with a blank line between them."""
    rows = table(spark, d, "conversations").where("conv_id is not null and text is not null")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


_TALKS = "t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)"
_SECTIONS = f"{_TALKS}, p AS (SELECT conv_id, i - 1 AS i, trim(part[i]) AS text FROM (SELECT conv_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT conv_id, string_split(text, chr(10) || chr(10)) AS part FROM t)) WHERE trim(part[i]) <> ''), sections AS (SELECT conv_id, CAST(i AS INTEGER) AS position, concat('Section ', i + 1) AS title, CAST(i // 3 + 1 AS INTEGER) AS page, text FROM p)"


@query("doc_sections_text", f"WITH {_SECTIONS} SELECT * FROM sections")
def _(spark, d):
    return text.text_sections(talks(spark, d), "conv_id", "text")


@query("doc_full_text", f"WITH {_SECTIONS} SELECT conv_id, string_agg(concat('## ', title, chr(10), text), chr(10) || chr(10) ORDER BY position) AS full_text FROM sections GROUP BY 1")
def _(spark, d):
    return text.full_text(text.text_sections(talks(spark, d), "conv_id", "text"), "conv_id")


# documents as Markdown: a heading on top of every text
_MD = "SELECT doc_id, concat('before ', lang, chr(10), '# ', source, chr(10), text) AS md FROM documents"


@query("doc_sections_markdown", "SELECT doc_id, CAST(0 AS INTEGER) AS position, 'Introduction' AS title, CAST(length(lang) + 7 AS INTEGER) AS n FROM documents UNION ALL SELECT doc_id, 1, source, CAST(length(trim(text, chr(10) || ' ')) AS INTEGER) FROM documents WHERE trim(text, chr(10) || ' ') <> ''")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("before "), "lang", F.lit("\n# "), "source", F.lit("\n"), "text").alias("md"))
    return text.markdown_sections(rows, "doc_id", "md").select("doc_id", "position", "title", F.length("text").alias("n"))


@query("doc_sections_html")
def _(spark, d):
    return text.html_sections(table(spark, d, "pages"), "page_id", "html")


@query("doc_sections_csv", "SELECT page_id, concat('Columns: url,id', chr(10), 'Rows: 1', chr(10), url, ',', page_id) AS text FROM pages")
def _(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("url,id\n"), "url", F.lit(","), F.col("page_id").cast("string")).alias("csv"))
    return text.csv_sections(rows, "page_id", "csv").select("page_id", "text")


@query("doc_sections_json", "SELECT event_id, 'Keys: k' AS text FROM events")
def _(spark, d):
    return text.json_sections(table(spark, d, "events"), "event_id", "props").select("event_id", "text")


@query("doc_sections_docx")
def _(spark, d):
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pandas as pd

    def pack(batches):
        for pdf in batches:
            out = []
            for body in pdf["text"]:
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    paragraphs = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in (body or "").split("\n"))
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
                out.append(buffer.getvalue())
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    files = table(spark, d, "benchmark").select(F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"), "text").mapInPandas(pack, "path string, content binary")
    return text.docx_sections(files)


def chunks(spark, d) -> DataFrame:
    """Chunks of the conversations, of 120 words with 20 carried on."""
    return text.chunks(text.text_sections(talks(spark, d), "conv_id", "text"), "conv_id", 120, 20)


@query("doc_chunks")
def _(spark, d):
    docs = table(spark, d, "documents")
    return text.chunks(text.text_sections(docs, "doc_id", "text"), "doc_id").select("chunk_id", "doc_id", "section", "page", "chunk_index", "token_count", F.sha2("text", 256).alias("sha"))


_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens_sql(c: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}_-]+'), lambda w: trim(w, '-')), lambda w: regexp_matches(w, '^[a-z0-9_-]{{2,}}$') AND w NOT IN ({_WORDS}))"


@query("text_tokenize", f"SELECT doc_id, CAST(len(x) AS INTEGER) AS n_tokens, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, {_tokens_sql('text')} AS x FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(tokens(F.col("text")), " ")).alias("digest"))


# search: the benchmark items as queries over all conversation turns
_TURNS = "SELECT concat(CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS chunk_id, text, role AS section, conv_id AS page, concat('talk', CAST(conv_id AS STRING)) AS filename FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"
_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
_INDEX = f"""ch AS ({_TURNS}), qs AS ({_ASKED}), tk AS (SELECT chunk_id, {_tokens_sql("coalesce(text, '')")} AS x FROM ch), po AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(x) AS token FROM tk) GROUP BY 1, 2), le AS (SELECT chunk_id, len(x) AS length FROM tk),
df AS (SELECT token, count(*) AS df FROM po GROUP BY 1), al AS (SELECT count(*) AS n, avg(length) AS avgdl FROM le)"""
_BM25 = f"""{_INDEX}, qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_tokens_sql('query')}) AS token FROM qs) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))), 6) AS score FROM po JOIN qt USING (token) JOIN le USING (chunk_id) JOIN df USING (token), al GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0)"""


def turns(spark, d) -> DataFrame:
    return derived(spark, d, _TURNS)


def asked(spark, d) -> DataFrame:
    return derived(spark, d, _ASKED)


@query("bm25_index", f"WITH {_INDEX} SELECT po.token, df, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS tf FROM po JOIN df USING (token) GROUP BY 1, 2")
def _(spark, d):
    _, _, frequencies = retrieval.bm25_index(turns(spark, d))
    return frequencies.select("token", "df", F.col("df").alias("chunks"), "tf")


#: The same searches over whole documents.
_DOCUMENTS = "SELECT CAST(doc_id AS STRING) AS chunk_id, text, source AS section, doc_id AS page, concat('doc', CAST(doc_id AS STRING)) AS filename FROM documents WHERE doc_id IS NOT NULL"


@query("bm25_index_documents", f"WITH {_INDEX.replace(_TURNS, _DOCUMENTS)} SELECT po.token, df, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS tf FROM po JOIN df USING (token) GROUP BY 1, 2")
def _(spark, d):
    _, _, frequencies = retrieval.bm25_index(derived(spark, d, _DOCUMENTS))
    return frequencies.select("token", "df", F.col("df").alias("chunks"), "tf")


@query("bm25_search_documents", f"WITH {_BM25.replace(_TURNS, _DOCUMENTS)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 10")
def _(spark, d):
    return retrieval.bm25_search(asked(spark, d), derived(spark, d, _DOCUMENTS))


@query("bm25_search", f"WITH {_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 10")
def _(spark, d):
    return retrieval.bm25_search(asked(spark, d), turns(spark, d))


def _embed_sql(view: str, key: str, column: str, dim: int = 128) -> str:
    return rf"""{view}_w AS (SELECT {key} AS k, list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM {view}),
{view}_f AS (SELECT k, f, sum(v) AS v FROM (SELECT k, unnest(w) AS f, 1.0 AS v FROM {view}_w UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), 0.8 FROM {view}_w
 UNION ALL SELECT k, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))), 0.3 FROM (SELECT k, unnest(w) AS x FROM {view}_w)) GROUP BY 1, 2),
{view}_i AS (SELECT k, CAST(concat('0x', substr(md5(f), 31, 2)) AS INTEGER) % {dim} AS i, sum(v) AS v FROM {view}_f GROUP BY 1, 2),
{view}_e AS (SELECT k, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY k)), 6) AS x FROM {view}_i)"""


@query("embed_hash", f"WITH b AS (SELECT * FROM benchmark), {_embed_sql('b', 'item_id', 'text')} SELECT k AS item_id, CAST(i AS INTEGER) AS i, x FROM b_e")
def _(spark, d):
    rows = text.embed(table(spark, d, "benchmark"), "item_id", "text").select("item_id", F.posexplode("vector").alias("i", "x"))
    return rows.where("x <> 0").select("item_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("embed_hash_documents", f"WITH b AS (SELECT * FROM documents WHERE doc_id IS NOT NULL), {_embed_sql('b', 'doc_id', 'text')} SELECT k AS doc_id, CAST(i AS INTEGER) AS i, x FROM b_e")
def _(spark, d):
    rows = text.embed(table(spark, d, "documents").where("doc_id is not null"), "doc_id", "text").select("doc_id", F.posexplode("vector").alias("i", "x"))
    return rows.where("x <> 0").select("doc_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


_QUERY_VECTORS = "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 20 = 0"


@query("embed_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(coalesce(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 0), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


_VS = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e)), 6) AS score FROM v q, v c WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


@query("knn_join", _VS)
@query("vector_search", _VS)
def _(spark, d):
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_search(derived(spark, d, _QUERY_VECTORS), corpus)


@query("vector_count", "SELECT label AS project, count(*) AS vectors FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1")
def _(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").groupBy(F.col("label").alias("project")).agg(F.count("*").alias("vectors"))


@query("query_rewrite", "SELECT item_id, regexp_replace(trim(text), '[?!.]+$', '') AS query FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", retrieval.rewrite(F.col("text")).alias("query"))


def _hybrid_sql(k: int) -> str:
    """Both lists of 2 k and the ``k`` best of their fusion, as ``hybrid``."""
    vector = lambda v: f"{v}_x AS (SELECT k, i, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM {v}_e), {v}_n AS (SELECT k, sqrt(sum(x * x)) AS l FROM {v}_x GROUP BY 1)"
    return f"""{_BM25}, {_embed_sql('ch', 'chunk_id', 'text')}, {_embed_sql('qs', 'query_id', 'query')}, {vector('ch')}, {vector('qs')},
dots AS (SELECT q.k AS query_id, c.k AS chunk_id, sum(q.x * c.x) AS dot FROM qs_x q JOIN ch_x c USING (i) GROUP BY 1, 2),
sims AS (SELECT q.query_id, c.chunk_id, round(coalesce(dot / (qn.l * cn.l), 0), 6) AS score FROM qs q CROSS JOIN ch c LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN qs_n qn ON qn.k = q.query_id LEFT JOIN ch_n cn ON cn.k = c.chunk_id),
de AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sims),
fu AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, d.rank AS dense_rank, b.rank AS bm25_rank, round(coalesce(0.5 / (60 + d.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 8) AS rrf FROM (SELECT * FROM de WHERE rank <= {2 * k}) d FULL JOIN (SELECT * FROM bm WHERE rank <= {2 * k}) b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fu) WHERE rank <= {k})"""


@query("hybrid_search_documents", f"WITH {_hybrid_sql(10).replace(_TURNS, _DOCUMENTS)} SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, rrf, CAST(rank AS INTEGER) AS rank FROM hybrid")
def _(spark, d):
    return retrieval.hybrid_search(asked(spark, d), derived(spark, d, _DOCUMENTS)).select("query_id", "chunk_id", "dense_rank", "bm25_rank", "rrf", "rank")


@query("rank_fusion_join", f"WITH {_hybrid_sql(10)} SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, rrf, CAST(rank AS INTEGER) AS rank FROM hybrid")
def _(spark, d):
    q, c = asked(spark, d), turns(spark, d)
    dense = retrieval.vector_search(text.embed(q, "query_id", "query"), text.embed(c, "chunk_id", "text"), 20)
    return retrieval.rank_fusion(dense, retrieval.bm25_search(q, c, 20)).where("rank <= 10").select("query_id", "chunk_id", "dense_rank", "bm25_rank", "rrf", "rank")


@query("hybrid_search", f"WITH {_hybrid_sql(10)} SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(bm25_rank AS INTEGER) AS bm25_rank, rrf, CAST(rank AS INTEGER) AS rank FROM hybrid")
def _(spark, d):
    return retrieval.hybrid_search(asked(spark, d), turns(spark, d)).select("query_id", "chunk_id", "dense_rank", "bm25_rank", "rrf", "rank")


_RERANK = f"""{_BM25}, ca AS (SELECT b.query_id, b.chunk_id, q.query, b.score, c.text, c.section FROM bm b JOIN qs q USING (query_id) JOIN ch c USING (chunk_id) WHERE b.rank <= 10),
te AS (SELECT *, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: length(t) > 2) AS t FROM ca),
rr AS (SELECT query_id, chunk_id, round(0.40 * score + 0.35 * CASE WHEN len(t) = 0 THEN 0.5 ELSE len(list_filter(t, lambda x: contains(lower(text), x))) / len(t) END + 0.15 * CASE WHEN len(regexp_split_to_array(trim(lower(query)), '\\s+')) > 1 AND contains(lower(text), trim(lower(query))) THEN 0.35 ELSE 0 END + 0.10 * CASE WHEN len(list_filter(t, lambda x: contains(lower(section), x))) > 0 THEN 0.15 ELSE 0 END, 6) AS rerank_score FROM te),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM rr)""".replace("\\\\", "\\")


_EVIDENCE = _hybrid_sql(15).replace(f"qs AS ({_ASKED})", "qs AS (SELECT item_id AS query_id, regexp_replace(trim(text), '[?!.]+$', '') AS query FROM benchmark)") + ", " + _RERANK[_RERANK.index("te AS (") :].replace("FROM ca)", "FROM (SELECT h.query_id, h.chunk_id, q.query, h.rrf AS score, c.text, c.section FROM hybrid h JOIN qs q USING (query_id) JOIN ch c USING (chunk_id)))")


def whole_documents(spark, d) -> DataFrame:
    return derived(spark, d, _DOCUMENTS)


def _candidates(spark, d, chunks=turns) -> DataFrame:
    q, c = asked(spark, d), chunks(spark, d)
    return c.join(few(retrieval.bm25_search(q, c).join(q, "query_id")), "chunk_id").select("query_id", "chunk_id", "query", "score", "text", "section")


@query("rerank", f"WITH {_RERANK} SELECT query_id, chunk_id, rerank_score, CAST(rank AS INTEGER) AS rank FROM reranked WHERE rank <= 5")
def _(spark, d):
    return retrieval.rerank(_candidates(spark, d))


@query("rerank_documents", f"WITH {_RERANK.replace(_TURNS, _DOCUMENTS)} SELECT query_id, chunk_id, rerank_score, CAST(rank AS INTEGER) AS rank FROM reranked WHERE rank <= 5")
def _(spark, d):
    return retrieval.rerank(_candidates(spark, d, whole_documents))


@query("retrieve_evidence_documents", f"WITH {_EVIDENCE.replace(_TURNS, _DOCUMENTS)} SELECT query_id, chunk_id, rerank_score, CAST(rank AS INTEGER) AS rank FROM reranked WHERE rank <= 5")
def _(spark, d):
    return retrieval.retrieve_evidence(asked(spark, d), whole_documents(spark, d))


@query("retrieve_evidence", f"WITH {_EVIDENCE} SELECT query_id, chunk_id, rerank_score, CAST(rank AS INTEGER) AS rank FROM reranked WHERE rank <= 5")
def _(spark, d):
    return retrieval.retrieve_evidence(asked(spark, d), turns(spark, d))


_CITED = f"""WITH {_RERANK}, ci AS (SELECT query_id, chunk_id, concat('Document: ', filename, ', Page ', page, ', Section: ', section) AS citation, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS snippet, CAST(round(CAST(rerank_score AS DECIMAL(18, 6)), 4) AS DOUBLE) AS confidence FROM reranked JOIN ch USING (chunk_id) WHERE rank <= 4)"""


def _cited(spark, d, chunks=turns) -> DataFrame:
    found = chunks(spark, d).join(few(retrieval.rerank(_candidates(spark, d, chunks), 4)), "chunk_id").withColumn("score", F.col("rerank_score"))
    return retrieval.citations(found)


@query("citations", f"{_CITED} SELECT * FROM ci")
def _(spark, d):
    return _cited(spark, d)


@query("citations_documents", f"{_CITED.replace(_TURNS, _DOCUMENTS)} SELECT * FROM ci")
def _(spark, d):
    return _cited(spark, d, whole_documents)


@query("answers", f"{_CITED}, a AS (SELECT query_id, string_agg(snippet, chr(10) ORDER BY confidence DESC, chunk_id) AS answer, count(*) AS citations FROM ci GROUP BY 1) SELECT qs.query_id, coalesce(answer, '') AS answer, answer IS NOT NULL AS grounded, coalesce(citations, 0) AS citations FROM qs LEFT JOIN a USING (query_id)")
def _(spark, d):
    return retrieval.answers(asked(spark, d), _cited(spark, d))


@query("index_documents")
def _(spark, d):
    index = retrieval.index_documents(table(spark, d, "documents"), scratch(spark, "index"), "doc_id", "text")
    return index.postings().groupBy("token").agg(F.count("*").alias("chunks"), F.sum("tf").alias("tf")).join(index.frequencies(), "token")


#: Documents after three batches: all; every tenth replaced by its text and source; every seventh deleted.
_KEPT = "SELECT CAST(doc_id AS STRING) AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN concat(text, ' ', source) ELSE text END AS text, source AS section, doc_id AS page, '' AS filename FROM documents WHERE doc_id % 7 <> 0"


def maintained(spark, d) -> TextIndex:
    """The whole documents in an index of three batches, the second of which comes twice; then merged."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    index = TextIndex(spark, scratch(spark, "index"), chunker=whole_texts, vectors=False)
    index.commit("all", docs)
    for _ in range(2):
        index.commit("changed", docs.where("doc_id % 10 = 0").select("doc_id", F.concat("text", F.lit(" "), "source").alias("text")))
    index.commit("deleted", deleted=docs.where("doc_id % 7 = 0"))
    index.merge(index.segments()[1:])
    return index


@query("index_search", f"WITH {_BM25.replace(_TURNS, _KEPT)} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 10")
def _(spark, d):
    return maintained(spark, d).search(asked(spark, d))


@query("index_frequencies", f"WITH {_INDEX.replace(_TURNS, _KEPT)} SELECT token, df FROM df")
def _(spark, d):
    return maintained(spark, d).frequencies()


@query("doc_chunks_lateral")
def _(spark, d):
    """The chunks of ``doc_chunks`` by SQL that calls the table function for each section."""
    text.register(spark)
    sections = text.text_sections(table(spark, d, "documents"), "doc_id", "text")
    return spark.sql(
        """SELECT concat(doc_id, '_chk_', at) AS chunk_id, doc_id, section, page, at AS chunk_index, token_count, sha2(text, 256) AS sha
        FROM (SELECT s.doc_id, s.title AS section, CAST(s.page AS INT) AS page, c.text, c.token_count, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY s.position, c.chunk_index) - 1 AS INT) AS at
          FROM {sections} s, LATERAL doc_chunks(s.text, 400, 50) c)""",
        sections=sections,
    )
