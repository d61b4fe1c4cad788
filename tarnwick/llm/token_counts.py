"""Token counts kept as additive totals by source, language and tokenizer version.

A batch of signed changes (+1 insert, -1 delete; a revised count is a -1 of the old and a +1 of the new) is
summed and written as a delta under its batch id, then added to the totals: a new table of sums beside the
list of the batches in it. A batch costs its own size and that of the totals, never the corpus's. It counts once
Spark's writer has committed its delta; a replay changes nothing, also after the deltas are gone, and what
breaks off is done anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import STEP_BYTES, read_ranks
from .common import free_name, slices

KEYS = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def counted(docs: DataFrame, vocabularies: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with a column for each of ``vocabularies`` (name to path of a rank file): how many tokens the whole text has. A null or empty text has none; rows are kept as they are.

    Tokens are those of the tiktoken library, without special tokens, in slices of bounded bytes. A column with the name of a vocabulary is replaced.
    """
    ranks = [read_ranks(path) for path in vocabularies.values()]
    names = [c for c in docs.columns if c not in vocabularies]
    given = docs.select(*names, F.col(text).cast("string").alias(free_name(docs, "t")))

    def run(batches):
        coders = [tiktoken.Encoding(f"own{i}", pat_str=pattern, mergeable_ranks=r, special_tokens={}) for i, r in enumerate(ranks)]
        for batch in batches:
            texts = batch.column(len(names)).fill_null("")
            counts = np.zeros((len(coders), len(batch)), np.int64)
            for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), STEP_BYTES):
                for i, text in enumerate(texts.slice(a, b - a).to_pylist(), a):
                    counts[:, i] = [len(coder.encode_ordinary(text)) for coder in coders]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *map(pa.array, counts)], [*names, *vocabularies])

    schema = given.select(*names, *[F.lit(0).cast("long").alias(v) for v in vocabularies]).schema
    return given.mapInArrow(run, schema)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def _listed(spark: SparkSession, path: str, start: str) -> list[str]:
    files, at = _folder(spark, path)
    found = [x.getPath() for x in files.listStatus(at) if x.isDirectory()] if files.exists(at) else []
    return sorted(x.toString() for x in found if x.getName().startswith(start))


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches whose deltas are there and count."""
    return [x for x in _listed(spark, path, "batch=") if _exists(spark, f"{x}/_SUCCESS")]


def _latest(spark: SparkSession, path: str) -> str | None:
    """The newest totals that are whole: their list of batches is written after their sums."""
    return next((x for x in reversed(_listed(spark, path, "totals=")) if _exists(spark, f"{x}/batches/_SUCCESS")), None)


def _merged(spark: SparkSession, path: str) -> DataFrame:
    """``(batch)``: names of the batches in the totals."""
    latest = _latest(spark, path)
    return spark.read.schema("batch string").parquet(f"{latest}/batches") if latest else spark.createDataFrame([], "batch string")


def _name(folder: str) -> str:
    return folder.rsplit("batch=", 1)[1]


def _open(spark: SparkSession, path: str) -> list[str]:
    """Folders of committed batches that are not in the totals yet, as after a writer that broke off."""
    folders = committed(spark, path)
    if not folders:
        return []
    known = {r["batch"] for r in _merged(spark, path).where(F.col("batch").isin([_name(x) for x in folders])).collect()}
    return [x for x in folders if _name(x) not in known]


def inserts(docs: DataFrame) -> DataFrame:
    """Changes that add ``docs`` of ``(source, lang, tokenizer, tokens)``. A null count is 0 tokens; a null key is a group of its own; other columns are left out."""
    return docs.select(*KEYS, F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.lit(1).alias("sign"))


def deletes(docs: DataFrame) -> DataFrame:
    """Changes that take ``docs`` away again."""
    return inserts(docs).withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put the counts of ``new`` in place of those of ``old``."""
    return deletes(old).union(inserts(new))


def commit(spark: SparkSession, path: str, batch_id: str, changes: DataFrame) -> bool:
    """Sum ``changes``, commit them as batch ``batch_id`` and add them to the totals; False, with nothing counted, if that batch is there already. A batch may be empty. One writer at a time. ``batch_id`` is made of letters, digits, ``-``, ``_`` and ``.``."""
    if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
        raise ValueError(f"no name of a batch: {batch_id!r}")
    if _exists(spark, f"{path}/batch={batch_id}/_SUCCESS") or not _merged(spark, path).where(F.col("batch") == batch_id).isEmpty():
        return False
    delta = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
    delta.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    _fold(spark, path)
    return True


def _fold(spark: SparkSession, path: str) -> None:
    """Add the committed batches that are not in the totals yet: new sums first, then the list of batches, which makes them count; the totals before the last are deleted."""
    folders = _open(spark, path)
    if not folders:
        return
    latest = _latest(spark, path)
    number = int(latest.rsplit("=", 1)[1]) + 1 if latest else 1
    target = f"{path}/totals={number:08d}"
    totals(spark, path).write.mode("overwrite").parquet(f"{target}/sums")
    names = spark.createDataFrame([(_name(x),) for x in folders], "batch string")
    _merged(spark, path).union(names).coalesce(1).write.mode("overwrite").parquet(f"{target}/batches")
    for old in _listed(spark, path, "totals="):
        if int(old.rsplit("=", 1)[1]) < number - 1:
            files, at = _folder(spark, old)
            files.delete(at, True)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``(source, lang, tokenizer, docs, tokens)`` of all committed batches: the totals, and deltas that are not in them yet. Groups that have come to nothing are left out. No batch: no rows."""
    latest, folders = _latest(spark, path), _open(spark, path)
    parts = [*([f"{latest}/sums"] if latest else []), *folders]
    sums = spark.read.schema(_SUMS).parquet(*parts) if parts else spark.createDataFrame([], _SUMS)
    return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Delete the deltas that are in the totals. The totals keep the names of their batches, so a replay still changes nothing."""
    _fold(spark, path)
    for folder in committed(spark, path):
        files, at = _folder(spark, folder)
        files.delete(at, True)
