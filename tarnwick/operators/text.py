"""Documents: sections of plain text, Markdown, HTML, CSV, JSON and DOCX; chunks; hashed embeddings."""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import STOP_WORDS, TOKEN, words

SECTION = "array<struct<title:string,page:int,text:string>>"


def doc_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def doc_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(doc_hash(content), 1, 12))


def text_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, position, title, page, text)``: parts between blank lines; titles and pages count blank parts too; a text without parts is one section."""
    parts = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\n")).alias("i", "part")).where(F.trim("part") != "")
    found = parts.select(key, F.col("i").alias("position"), F.concat(F.lit("Section "), (F.col("i") + 1).cast("string")).alias("title"), (F.floor(F.col("i") / 3) + 1).cast("int").alias("page"), F.trim("part").alias("text"))
    blank = docs.where(F.trim(F.coalesce(F.col(text), F.lit(""))).rlike(r"^\s*$")).select(F.col(key), F.lit(0).alias("position"), F.lit("Section 1").alias("title"), F.lit(1).alias("page"), F.lit("").alias("text"))
    return found.unionByName(blank)


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, position, title, page, text)``: a heading of one to three ``#`` opens a section; what stands before it is the Introduction. Sections without text are left out."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line")).withColumn("head", F.regexp_extract("line", r"^#{1,3}\s+(.+)$", 1))
    at = F.sum((F.col("head") != "").cast("int")).over(Window.partitionBy(key).orderBy("n"))
    by = lines.withColumn("position", at.cast("int")).groupBy(key, "position").agg(F.max("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == "", F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("body"))
    return by.select(key, "position", F.when(F.col("head") == "", "Introduction").otherwise(F.trim("head")).alias("title"), F.lit(1).alias("page"), F.trim("body", F.lit(" \n")).alias("text")).where("text <> ''")


class _Text(HTMLParser):
    """Text outside script and style, with a line's end after each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "li", "tr"):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip() + " ")


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.parts).strip()


#: Pages that a task parses before it sends their texts on.
PAGES = 64


def html_sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, position, title, page, text)`` of HTML by the rules of plain text; each page is parsed once, some pages at a time."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                part = batch.slice(start, PAGES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([html_text(x.as_py()) for x in part.column(1)], pa.string())], ["k", "text"])

    kind = pages.schema[key].dataType.simpleString()
    plain = pages.select(F.col(key).alias("k"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"k {kind}, text string")
    # a text of white space alone is one section of its own, as in text_sections, but pages are not parsed anew for those
    body = F.coalesce("text", F.lit(""))
    blank = F.trim(body).rlike(r"^\s*$")
    own = F.array(F.struct(F.lit(0).alias("position"), F.lit("Section 1").alias("title"), F.lit(1).alias("page"), F.lit("").alias("text")))
    parts = F.transform(F.split(body, r"\n\n"), lambda part, i: F.struct(i.alias("position"), F.concat(F.lit("Section "), (i + 1).cast("string")).alias("title"), (F.floor(i / 3) + 1).cast("int").alias("page"), F.trim(part).alias("text")))
    found = F.filter(parts, lambda part: part["text"] != "")
    return plain.select(F.col("k").alias(key), F.inline(F.when(blank, F.concat(found, own)).otherwise(found)))


def csv_sections(docs: DataFrame, key: str, text: str, sample: int = 5) -> DataFrame:
    """``(key, title, text)``: header, first lines and number of rows of a CSV text."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(lines) - 1, F.lit(0))
    body = F.concat(F.lit("Columns: "), F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit("\nRows: "), n.cast("string"), F.lit("\n"), F.array_join(F.slice(lines, 2, sample), "\n"))
    return docs.select(F.col(key), F.lit("CSV Summary").alias("title"), body.alias("text"))


def json_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, title, text)``: the keys of an object, or the first two records of an array; else the text itself."""
    keys = F.json_object_keys(F.col(text))
    first = F.concat_ws("\n", F.get_json_object(F.col(text), "$[0]"), F.get_json_object(F.col(text), "$[1]"))
    return docs.select(F.col(key), F.lit("JSON Summary").alias("title"), F.when(keys.isNotNull(), F.concat(F.lit("Keys: "), F.array_join(keys, ", "))).when(first != "", first).otherwise(F.col(text)).alias("text"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_sections(files: DataFrame) -> DataFrame:
    """``(path, position, text)``: paragraphs of ``(path, content)`` DOCX files with text; one file a step."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                texts = ["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p")]
                keep = [t for t in texts if t.strip()]
                yield pd.DataFrame({"path": path, "position": range(len(keep)), "text": keep})

    return files.select("path", "content").mapInPandas(run, "path string, position int, text string")


def full_text(sections: DataFrame, key: str) -> DataFrame:
    """``(key, full_text)``: sections in order, each under its title."""
    parts = F.array_sort(F.collect_list(F.struct("position", "title", "text")))
    return sections.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), s["text"])), "\n\n").alias("full_text"))


def pack(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Greedy chunks of whole sentences, up to ``size`` words; a full chunk longer than ``overlap`` words hands its last ones on. A longer sentence stands whole."""
    out: list[str] = []
    held: list[str] = []
    for sentence in sentences:
        words = sentence.split()
        if held and len(held) + len(words) > size:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap and len(held) > overlap else []
        held += words
    if held:
        out.append(" ".join(held))
    return out


def pieces(text: str | None, size: int, overlap: int) -> list[str]:
    """The chunks of one section: its lines cut into sentences, packed."""
    sentences = [s for p in re.split(r"\n+", text or "") for s in re.split(r"(?<=[.?!])\s+", p.strip()) if s]
    return pack(sentences, size, overlap)


class DocChunks:
    """``doc_chunks(text, size, overlap)`` in SQL: ``(chunk_index, text, token_count)`` of a section."""

    def eval(self, text: str, size: int, overlap: int):
        for i, chunk in enumerate(pieces(text, size, overlap)):
            yield i, chunk, len(chunk.split())


def register(spark: SparkSession) -> None:
    """Make ``doc_chunks`` known to SQL as a table function, for lateral joins; rows travel in Arrow batches."""
    spark.udtf.register("doc_chunks", F.udtf(DocChunks, returnType="chunk_index int, text string, token_count int", useArrow=True))


def chunks(sections: DataFrame, key: str, size: int = 400, overlap: int = 50) -> DataFrame:
    """``(chunk_id, key, section, page, chunk_index, text, token_count)`` of ``(key, position, title, page, text)``; indexes run on over the sections of a document. Packing goes section by section in Arrow batches; only counts are summed over sections."""
    def run(batches):
        for pdf in batches:
            rows = []
            for k, position, title, page, text in zip(pdf["k"], pdf["position"], pdf["title"], pdf["page"], pdf["text"]):
                rows += [(k, position, title, page, i, c, len(c.split())) for i, c in enumerate(pieces(text, size, overlap))]
            yield pd.DataFrame(rows, columns=["k", "position", "section", "page", "i", "text", "token_count"])

    kind = sections.schema[key].dataType.simpleString()
    packed = sections.select(F.col(key).alias("k"), F.col("position").cast("int"), "title", F.col("page").cast("int"), "text").mapInPandas(run, f"k {kind}, position int, section string, page int, i int, text string, token_count int")
    counts = packed.groupBy("k", "position").agg(F.count("*").alias("n"))
    before = counts.select("k", "position", (F.sum("n").over(Window.partitionBy("k").orderBy("position")) - F.col("n")).alias("before"))
    index = (F.col("before") + F.col("i")).cast("int")
    return packed.join(before, ["k", "position"]).select(F.concat(F.col("k").cast("string"), F.lit("_chk_"), index.cast("string")).alias("chunk_id"), F.col("k").alias(key), "section", "page", index.alias("chunk_index"), "text", "token_count")


#: Words whose places a worker remembers, the longest that it does, and the words counted at once.
REMEMBERED, LONGEST, AT_ONCE = 100_000, 64, 20_000


class _Features:
    """Tenths that a text adds to each of ``dim`` places: 10 for a word, 3 for each of its 3-grams, 8 for a pair of words."""

    def __init__(self, dim: int):
        self.dim = dim
        self.known: dict[str, list[int]] = {}
        self.grams: dict[str, int] = {}  # 37 characters make no more than 50,653

    def places(self, features: list[str]) -> list[int]:
        md5, number, dim = hashlib.md5, int.from_bytes, self.dim
        return [number(md5(f.encode(), usedforsecurity=False).digest()) % dim for f in features]

    def word(self, w: str) -> list[int]:
        """The places of a word's 3-grams."""
        found = self.known.get(w)
        if found is None:
            grams = [w[i : i + 3] for i in range(len(w) - 2)]
            new = [g for g in grams if g not in self.grams]
            self.grams.update(zip(new, self.places(new)))
            found = [self.grams[g] for g in grams]
            if len(w) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[w] = found
        return found

    def count(self, places: list[int]) -> np.ndarray:
        return np.bincount(np.array(places, np.int64), minlength=self.dim)

    def text(self, text: str) -> np.ndarray:
        words = re.findall("[a-z0-9_]+", text)
        out = np.zeros(self.dim, np.int64)
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE]
            pairs = [f"{a}_{b}" for a, b in itertools.pairwise(words[i : i + AT_ONCE + 1])]
            grams = list(itertools.chain.from_iterable(map(self.word, part)))
            out += 10 * self.count(self.places(part)) + 8 * self.count(self.places(pairs)) + 3 * self.count(grams)
        return out


def embed(docs: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """``(key, vector array<float>)``: md5-hashed words (1), their character 3-grams (0.3) and word pairs (0.8), added up by md5 modulo ``dim`` and scaled to length 1; a text without words is all zeros. Texts are counted where they lie, in tenths and thus exactly; rows of one key are added up."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        features = _Features(dim)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                places = np.concatenate([features.text(x.as_py()) for x in part.column(1)])
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))], ["k", "t"])

    given = docs.select(F.col(key).alias("k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    counted = given.mapInArrow(run, f"k {kind}, t array<bigint>")
    by = counted.groupBy("k").agg(F.array(*[F.sum(F.get("t", F.lit(i))) for i in range(dim)]).alias("t"))
    length = F.sqrt(F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x * x))
    measured = by.withColumn("length", length)
    return measured.select(F.col("k").alias(key), F.transform("t", lambda x: F.when(F.col("length") > 0, F.round(x / F.col("length"), 6)).otherwise(0.0).cast("float")).alias("vector"))


def term_rows(chunks_: DataFrame, keys: str | list[str], text: str) -> DataFrame:
    """``(keys, length, terms)`` of each row: how many tokens its text has, and each token with its ``tf``. Words are cut where a text lies and judged as tokens once for some texts; nothing is shuffled."""
    by = [keys] if isinstance(keys, str) else list(keys)
    fields = [f"k{i}" for i in range(len(by))]

    def run(batches):
        stop = pa.array(STOP_WORDS)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, n = part.column(len(by)), part.num_rows
                coded = found.flatten().dictionary_encode()
                # several words may be one token, and most are judged many times by their code
                named = pc.utf8_trim(coded.dictionary, characters="-").dictionary_encode()
                fit = pc.and_(pc.match_substring_regex(named.dictionary, TOKEN), pc.invert(pc.is_in(named.dictionary, value_set=stop))).to_numpy(zero_copy_only=False)
                token = named.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
                kept = fit[token]
                size = max(1, len(named.dictionary))
                pairs, times = np.unique(row[kept] * size + token[kept], return_counts=True)
                terms = pa.StructArray.from_arrays([named.dictionary.take(pa.array(pairs % size)), pa.array(times)], ["token", "tf"])
                ends = np.searchsorted(pairs, np.arange(n + 1) * size).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(by))), pa.array(np.bincount(row[kept], minlength=n)), pa.ListArray.from_arrays(pa.array(ends), terms)], [*fields, "length", "terms"])

    kinds = ", ".join(f"{f} {chunks_.schema[k].dataType.simpleString()}" for f, k in zip(fields, by))
    given = chunks_.select(*[F.col(k).alias(f) for f, k in zip(fields, by)], words(F.col(text)).alias("t"))
    return given.mapInArrow(run, f"{kinds}, length bigint, terms array<struct<token: string, tf: bigint>>").toDF(*by, "length", "terms")


def term_counts(chunks_: DataFrame, keys: str | list[str], text: str, unique: bool = False) -> DataFrame:
    """``(keys, token, tf)``. Tokens are counted where a text lies, some texts at a time; only where keys come again, which is looked up unless they are known to be ``unique``, are counts added up by a shuffle."""
    by = [keys] if isinstance(keys, str) else list(keys)
    counted = term_rows(chunks_, by, text).select(*by, F.inline("terms"))
    if unique or chunks_.groupBy(*by).count().where("count > 1").isEmpty():
        return counted
    return counted.groupBy(*by, "token").agg(F.sum("tf").alias("tf"))


def term_counts_of(chunks_: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """``(key, token, tf)`` of the tokens in ``asked(token)`` alone: other words are dropped before anything is shuffled."""
    found = chunks_.select(F.col(key), F.explode(words(F.col(text))).alias("token")).withColumn("token", F.trim("token", F.lit("-")))
    return found.join(asked, "token", "left_semi").groupBy(key, "token").agg(F.count("*").alias("tf"))
