"""Queries over the given tables, one for each operator of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, decontamination, embedding_dedup, language, licenses, lines, minhash, periods, secret_scan, sharding, token_counts, urls
from .common import checkpoint_dir, cut, join_by_count

#: Fixed by the contract of the URL query: host, path, verdict.
LISTED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Tokenizer versions, oldest first: rank files of the public tokenizers.
TOKENIZERS = ["byte_bpe_50k", "byte_bpe_multi_50k"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, language, hundred and id; a directory's licence file is its first document with a statement."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan(docs, "path", F.col("k") == F.col("first"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is its document: labels of low quality or toxicity make a page bad."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.select("url", F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\.html|/|$)", 1).try_cast("long").alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return urls.judge(pages, labelled, LISTED)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations, for the dictionary coverage of secret candidates."""
    return table(spark, sf_dir, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))).alias("word")).distinct()


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), dictionary(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, the second committed twice: all are counted by the first tokenizer; those
    with labels are counted anew by the second; copies of a text go but for that with the least doc_id."""
    first, second = TOKENIZERS
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.coalesce(F.sha2("text", 256), F.lit("")).alias("body"))
    path = f"{checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    vocabularies = {name: public_tokenizers.path(f"{name}.tiktoken") for name in TOKENIZERS}
    # both versions in one scan: a join of the texts with the labels would move all texts
    token_counts.counted(docs, vocabularies, public_tokenizers.PATTERN).drop("text").write.parquet(f"{path}/counted")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    counted = spark.read.parquet(f"{path}/counted").join(labelled, "doc_id", "left").withColumn("again", F.coalesce("labelled", F.lit(False))).drop("labelled")
    counted.write.parquet(f"{path}/marked")
    counted = spark.read.parquet(f"{path}/marked")
    by = lambda rows, name: rows.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(name).alias("tokens"))
    rollup = f"{path}/rollup"
    token_counts.commit(spark, rollup, "1", token_counts.inserts(by(counted, first)))
    revised = counted.where("again")
    for _ in range(2):
        token_counts.commit(spark, rollup, "2", token_counts.revisions(by(revised, first), by(revised, second)))
    least = cut(counted.groupBy("body").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    copies = join_by_count(counted, least, ["body"], "times").where("doc_id > least")
    held = copies.select("source", "lang", F.when(F.col("again"), F.lit(second)).otherwise(F.lit(first)).alias("tokenizer"), F.when(F.col("again"), F.col(second)).otherwise(F.col(first)).alias("tokens"))
    token_counts.commit(spark, rollup, "3", token_counts.deletes(held))
    token_counts.compact(spark, rollup)
    return token_counts.totals(spark, rollup)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Fixed by the contract of the query of periodic runs: in some documents the words from one on repeat those that follow it, over and over."""
    if doc_id is None:
        return None
    tens, ones = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if ones:
        return None
    a = tens % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + tens % 8))
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(table(spark, sf_dir, "documents"), order=looped))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return alignment.end_links(table(spark, sf_dir, "documents"), a, alignment.Tokenizer(public_tokenizers.path("piece_bpe_32k.model")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {q.__name__: q for q in (op1_kk_sharding, op2_license_scan, op3_byte_bpe, op4_decontamination, op5_embedding_dedup, op6_url_rules, op7_secret_scan, op8_language, op9_circulant_minhash, op10_token_rollup, op11_periodic_runs, op12_token_alignment, op13_line_dedup)}

_TEMPLATES = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))

SQL: dict[str, str] = {
    "op2_license_scan": rf"""
WITH template(template, licence, text) AS (VALUES {_TEMPLATES}),
docs AS (SELECT doc_id, text, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path FROM documents),
split AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs UNION ALL
  SELECT doc_id, unnest(string_split_regex(text, '{licenses.BLANK}')) FROM docs UNION ALL SELECT doc_id, text FROM docs) WHERE regexp_matches(line, '{licenses.ANCHOR}')),
lines AS (SELECT line, count(*) AS times FROM split GROUP BY 1),
words AS (SELECT line, times, word, count(*) AS tf FROM (SELECT line, times, unnest(regexp_extract_all(lower(line), '{licenses._TOKEN}')) AS word FROM lines) GROUP BY ALL),
own AS (SELECT template, licence, word, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{licenses._TOKEN}')) AS word FROM template) GROUP BY ALL),
held AS (SELECT word, sum(times) AS n FROM words GROUP BY 1),
total AS (SELECT coalesce(sum(times), 0) AS a FROM lines),
lw AS (SELECT line, word, tf * (ln((1 + a) / (1 + n)) + 1) AS w FROM words JOIN held USING (word), total),
tw AS (SELECT template, licence, word, tf * (ln((1 + a) / (1 + coalesce(n, 0))) + 1) AS v FROM own LEFT JOIN held USING (word), total),
ll AS (SELECT line, sqrt(sum(w * w)) AS l FROM lw GROUP BY 1),
tl AS (SELECT template, sqrt(sum(v * v)) AS l FROM tw GROUP BY 1),
dots AS (SELECT line, template, licence, sum(w * v) AS dot FROM lw JOIN tw USING (word) GROUP BY ALL),
scored AS (SELECT line, licence, round(dot / (ll.l * tl.l), 6) AS cosine FROM dots JOIN ll USING (line) JOIN tl USING (template)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence) = 1),
stated AS (SELECT doc_id, licence, cosine FROM split JOIN best USING (line) WHERE cosine >= 0.8
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
paths AS (SELECT doc_id, path, regexp_extract(path, '(?s)^(.*)/', 1) AS dir FROM docs),
files AS (SELECT dir, licence, cosine FROM paths JOIN stated USING (doc_id) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY doc_id) = 1),
above AS (SELECT dir, n, array_to_string(string_split(dir, '/')[1:n], '/') AS holder FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM paths))),
near AS (SELECT a.dir, a.holder, f.licence, f.cosine FROM above a JOIN files f ON f.dir = a.holder QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY n DESC) = 1)
SELECT p.doc_id, p.path, coalesce(s.licence, n.licence) AS licence,
  CASE WHEN s.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN s.licence IS NOT NULL THEN s.cosine ELSE n.cosine END AS cosine, CASE WHEN s.licence IS NULL THEN n.holder END AS directory
FROM paths p LEFT JOIN stated s USING (doc_id) LEFT JOIN near n USING (dir)
""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
good AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
part AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN part p ON p.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
""",
    "op9_circulant_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
post AS (SELECT rep, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM post a JOIN post b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS node, rep AS seen FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
part AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(p.component, s.doc_id) AS component_id, s.doc_id = coalesce(p.component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON list_sort(s.s) = c.s LEFT JOIN part p ON p.node = c.rep
""",
    "op11_periodic_runs": r"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT *, len(w) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)::BIGINT END AS h FROM given),
spot AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed),
loop AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM spot),
texts AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM loop),
fives AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS five FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM texts WHERE n >= 6)),
-- stretches of words that stay equal to those q words on: four periods and six words have five equal ones at least
equal AS (SELECT x.r, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS island FROM fives x JOIN fives y ON x.r = y.r AND x.five = y.five AND x.i < y.i),
stretch AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 5 + q AS length FROM equal GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS q FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
told AS (SELECT r, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, q := q), length * 1000000000 - start) AS top, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS listed FROM runs GROUP BY r),
lost AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM texts) ANTI JOIN lost USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
""",
    "op13_line_dedup": r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM rows),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
found AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN found USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
""",
}
