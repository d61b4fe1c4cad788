"""A text index that grows, replaces, forgets and merges: segments with tombstones, and document frequencies by signed deltas.

A batch of new, changed and deleted documents is one segment: chunks, words (a row a chunk: its length, and its tokens with
their counts) and vectors of what came, the keys of earlier segments that it replaces or removes, and how much each token's document frequency changes by all this. A row counts while no
later segment names its key. Segments of like size are merged into one that stands for all their batches. A segment
counts once its list of batches is written, so what breaks off is done anew and a replayed batch changes nothing. One writer
at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import folders
from ..functions.lineage import few
from . import lexical_index, text as text_ops, vector_index


def whole_texts(docs: DataFrame, key: str) -> DataFrame:
    """Each document of ``(key, text)`` as one chunk named by its key."""
    return docs.select(F.col(key), F.col(key).cast("string").alias("chunk_id"), "text")


def by_sections(docs: DataFrame, key: str) -> DataFrame:
    """Chunks of the sections of ``(key, text)``."""
    return text_ops.chunks(text_ops.text_sections(docs, key, "text"), key).select(key, "chunk_id", "text")


#: Most keys, of a batch or of all tombstones, that are sent to all tasks.
KEYS = 1_000_000


class TextIndex:
    """The index under ``path``, a folder that all executors share; keys are of ``kind``. ``vectors`` false leaves embeddings out."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint", chunker: Callable[[DataFrame, str], DataFrame] = by_sections, vectors: bool = True):
        self.spark, self.path, self.key, self.kind, self.chunker, self.vectors = spark, path, key, kind, chunker, vectors

    def segments(self) -> list[tuple[int, int]]:
        """First and last number of the segments that count, in order: committed ones that no merged one stands for."""
        found = [tuple(map(int, name.split("-"))) for name in folders.listed(self.spark, self.path) if folders.exists(self.spark, f"{self.path}/{name}/batches/_SUCCESS")]
        return sorted(s for s in found if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in found))

    def _folder(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/{segment[0]:012d}-{segment[1]:012d}"

    def _read(self, name: str, segments: list[tuple[int, int]]) -> DataFrame:
        """``name`` of some segments, with each one's last number as ``seq``."""
        schema = self._schemas()[name]
        parts = [self.spark.read.schema(schema).parquet(f"{self._folder(s)}/{name}").withColumn("seq", F.lit(s[1])) for s in segments]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], f"{schema}, seq int")

    def _schemas(self) -> dict[str, str]:
        own = f"{self.key} {self.kind}, chunk_id string"
        return {"given": f"{self.key} {self.kind}, text string", "chunks": f"{own}, text string", "words": f"{own}, length bigint, terms array<struct<token: string, tf: bigint>>", "vectors": f"{own}, vector array<float>", "gone": f"{self.key} {self.kind}", "change": "token string, df bigint", "batches": "batch string"}

    def batches(self) -> set[str]:
        """Names of the batches that count."""
        return {r["batch"] for r in self._read("batches", self.segments()).collect()}

    def _live(self, name: str, segments: list[tuple[int, int]] | None = None, upto: list[tuple[int, int]] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows of ``name`` in ``segments`` whose key no later one of ``upto`` names; only those of ``keys(key)`` if given."""
        segments = self.segments() if segments is None else segments
        rows = self._read(name, segments)
        if keys is not None:
            rows = rows.join(few(keys, KEYS), self.key, "left_semi")
        later = [s for s in upto or segments if s[1] > segments[0][1]] if segments else []
        if not later:
            return rows.drop("seq")
        last = self._read("gone", later).groupBy(self.key).agg(F.max("seq").alias("last"))
        last = few(last.withColumnRenamed(self.key, "key_"), KEYS)
        return rows.join(last, (F.col(self.key) == F.col("key_")) & (F.col("seq") < F.col("last")), "left_anti").drop("seq")

    def _write(self, df: DataFrame, segment: tuple[int, int], name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self._folder(segment)}/{name}")

    def commit(self, batch: str, docs: DataFrame | None = None, deleted: DataFrame | None = None, text: str = "text") -> bool:
        """Take in ``docs(key, text)``, which replace documents of the same keys, and forget ``deleted(key)``. False if ``batch`` counts already: nothing changes then.

        Of rows with one key the one with the greatest text stands (a null text last); a key that is deleted as well is
        forgotten. Rows with a null key are left out. A document without words is known, with length 0.
        """
        if batch in self.batches():
            return False
        key, segments = self.key, self.segments()
        number = segments[-1][1] + 1 if segments else 1
        here = (number, number)
        none = self.spark.createDataFrame([], f"{key} {self.kind}, text string")
        given = none if docs is None else docs.select(F.col(key).cast(self.kind).alias(key), F.col(text).cast("string").alias("text")).where(F.col(key).isNotNull())
        self._write(given, here, "given")
        given = self._read("given", [here]).drop("seq")
        again = few(given.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), KEYS)
        if not again.isEmpty():  # no other texts are shuffled
            given = given.join(again, key, "left_anti").unionAll(given.join(again, key, "left_semi").groupBy(key).agg(F.max("text").alias("text")))
        gone = given.select(key)
        if deleted is not None:
            dropped = few(deleted.select(F.col(key).cast(self.kind).alias(key)).where(F.col(key).isNotNull()).distinct(), KEYS)
            given = given.join(dropped, key, "left_anti")
            gone = given.select(key).unionAll(dropped)
        self._write(gone if segments else none.select(key), here, "gone")  # a first segment stands in no other's place
        self._write(self.chunker(given, key).select(key, "chunk_id", "text"), here, "chunks")
        chunks = self._read("chunks", [here]).drop("seq")
        self._write(text_ops.term_rows(chunks, [key, "chunk_id"], "text"), here, "words")
        if self.vectors:
            own = text_ops.embed(chunks, "chunk_id", "text").join(chunks.select(key, "chunk_id"), "chunk_id")
            self._write(own.select(key, "chunk_id", "vector"), here, "vectors")
        of = lambda rows, df: rows.select(F.explode("terms.token").alias("token"), F.lit(df).cast("long").alias("df"))
        new = of(self._read("words", [here]), 1)
        if segments:
            new = new.unionAll(of(self._live("words", segments, keys=self._read("gone", [here]).select(key)), -1))
        self._write(new.groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"), here, "change")
        self._write(self.spark.createDataFrame([(batch,)], "batch string"), here, "batches")
        folders.remove(self.spark, f"{self._folder(here)}/given")
        return True

    def merge(self, segments: list[tuple[int, int]]) -> None:
        """One segment in place of neighbouring ones. Keys that only older segments could hold are forgotten where there are none older."""
        here, everything = (segments[0][0], segments[-1][1]), self.segments()
        later = [s for s in everything if s[0] >= here[0]]
        for name in ("chunks", "words", *["vectors"] * self.vectors):
            self._write(self._live(name, segments, later), here, name)
        gone = self._read("gone", segments).select(self.key).distinct()
        self._write(gone if everything[0] != segments[0] else gone.limit(0), here, "gone")
        self._write(self._read("change", segments).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"), here, "change")
        self._write(self._read("batches", segments).select("batch"), here, "batches")
        for s in segments:
            folders.remove(self.spark, self._folder(s))

    def tidy(self, fan: int = 4) -> None:
        """Merge the newest ``fan`` segments and more while they are within ``fan`` times each other's size, so that a row is written again a number of times that grows with the logarithm of the index."""
        while True:
            segments = self.segments()
            size = {s: max(1, folders.size(self.spark, self._folder(s))) for s in segments}
            run = segments[-1:]
            for s in reversed(segments[:-1]):
                if size[s] > fan * max(size[r] for r in run):
                    break
                run.insert(0, s)
            if len(run) < fan:
                return
            self.merge(run)

    def chunks(self) -> DataFrame:
        return self._live("chunks")

    def postings(self) -> DataFrame:
        return self._live("words").select(self.key, "chunk_id", F.inline("terms"))

    def lengths(self) -> DataFrame:
        return self._live("words").select(self.key, "chunk_id", "length")

    def embeddings(self) -> DataFrame:
        return self._live("vectors")

    def frequencies(self) -> DataFrame:
        """``(token, df)`` of the chunks that count, from the deltas alone."""
        return self._read("change", self.segments()).groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, queries: DataFrame, k: int = 10, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """``(query_key, chunk_id, score, rank)`` by BM25 over the chunks that count."""
        words = self._live("words")
        postings = words.select("chunk_id", "length", F.inline("terms"))
        return lexical_index.search(queries, postings, words.select("chunk_id", "length"), self.frequencies(), k, "chunk_id", query_key, query)

    def nearest(self, queries: DataFrame, k: int = 10, query_key: str = "query_id", query: str = "query") -> DataFrame:
        """``(query_key, chunk_id, score, rank)`` by cosine of hashed embeddings."""
        return vector_index.search(text_ops.embed(queries, query_key, query), self.embeddings(), k, query_key=query_key)
