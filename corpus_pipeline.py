"""A corpus pipeline in five stages, each a function of (spark, docs, sf_dir) that returns a DataFrame.

``docs`` has the columns of ``documents`` (and any others, which are carried along); each stage works on all
that its predecessor kept, and all but the last return the same columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwick.llm import bpe, decontamination, entries, language, minhash, secret_scan
from tarnwick.llm.common import checkpoint_dir


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: null texts, texts without letters and scores under the calibrated bound."""
    return language.known(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the least doc_id stays; of rows of the same doc_id and text one. Rows without a doc_id are judged by their texts and come last in a group."""
    return minhash.without_copies(docs, 80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy of a benchmark item, edited or in part, whatever their doc_id."""
    return decontamination.clean(docs, entries.table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and counts their characters anew; all documents stay, and all are judged by their own texts, whatever their doc_id."""
    out = secret_scan.redact(docs, secret_scan.scan(docs, entries.dictionary(spark, sf_dir)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)``."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, True)


STAGES = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", hide_secrets),
    ("byte-level BPE", tokenise),
]
#: Language ID and secret scans are trained models, so SQL cannot say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what each keeps is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
