"""Readers: by extension, and each format with its own rules."""

from __future__ import annotations

import csv
import io
import itertools
import re
import zipfile
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_DELIMITERS = ",;\t|"
#: Bytes that the Windows code page 1252 reads as other characters than Latin-1 does.
_WINDOWS = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _delimiter(header: str) -> str:
    """The most frequent delimiter of a header; a comma where there is none."""
    best = max(_DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding and delimiter of the first bytes of a CSV, which may end within a character."""
    try:
        encoding, text = "utf-8", head.decode()
    except UnicodeDecodeError as error:
        cut = error.start > len(head) - 4
        encoding, text = ("utf-8", head[: error.start].decode()) if cut else ("latin-1", head.decode("latin-1"))
    return encoding, _delimiter(text.split("\n", 1)[0])


class Dialect(NamedTuple):
    encoding: str
    delimiter: str
    header: str
    files: list[str]

    def names(self) -> list[str]:
        return next(csv.reader([self.header], delimiter=self.delimiter))


def _decoded(c: Column, encoding: str) -> Column:
    """A text read as Latin-1, as what its bytes mean in ``encoding``."""
    return F.translate(c, "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values())) if encoding == "windows-1252" else c


def dialects(spark: SparkSession, path: str) -> list[Dialect]:
    """Files of a CSV folder by what they have in common: encoding, delimiter and header line.

    One scan of the lines as bytes, one row a file from each task. A file is UTF-8 if all its lines are, Windows-1252 if it holds
    bytes of 0x80 to 0x9F that this code page knows and none that it doesn't, else Latin-1. The delimiter is the most frequent
    one of the first line that isn't blank (a comma where none is there). Files without such a line have no dialect.
    """
    raw = F.col("value").cast("binary")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at"),
        raw.alias("line"), F.is_valid_utf8("value").alias("utf8"), F.decode(raw, "ISO-8859-1").alias("latin"),
    )
    blank = F.trim("latin") == ""
    by = lines.where(~blank).groupBy("file").agg(
        F.min_by("line", "at").alias("line"), F.bool_and("utf8").alias("utf8"),
        F.bool_or(F.col("latin").rlike("[\u0080-\u009f]")).alias("windows"), F.bool_or(F.col("latin").rlike("[\u0081\u008d\u008f\u0090\u009d]")).alias("controls"),
    )
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("windows") & ~F.col("controls"), "windows-1252").otherwise("ISO-8859-1")
    rows = by.select("file", "line", encoding.alias("encoding")).groupBy("encoding", "line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    found = []
    for r in rows:
        header = bytes(r["line"]).decode({"UTF-8": "utf-8-sig", "windows-1252": "cp1252"}.get(r["encoding"], "latin-1"))
        found.append(Dialect(r["encoding"], _delimiter(header), header, [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)) for f in r["files"]]))
    return sorted(found, key=lambda x: x.files[0])


def _csv_reader(spark: SparkSession, dialect: Dialect):
    return spark.read.option("header", True).option("sep", dialect.delimiter).option("encoding", "UTF-8" if dialect.encoding == "UTF-8" else "ISO-8859-1")


def _in_order(dialect: Dialect, schema: T.StructType) -> T.StructType:
    """``schema`` in the order of the header; by position where no name of the header is known."""
    known = {f.name: f for f in schema}
    names = dialect.names()
    if not known.keys() & set(names) or len(set(names)) < len(names):
        return schema
    return T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])


def _common_types(parts: list[DataFrame]) -> list[DataFrame]:
    """Columns of one name get one type: numbers and times as Spark widens them, other mixtures are texts."""
    types: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema:
            types.setdefault(f.name, set()).add("number" if isinstance(f.dataType, T.NumericType) else "time" if isinstance(f.dataType, (T.DateType, T.TimestampType)) else f.dataType.simpleString())
    mixed = {n for n, kinds in types.items() if len(kinds) > 1}
    return [p.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in p.columns]) for p in parts]


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV files with headers: one, or a folder whose files may differ in encoding, delimiter and order of columns.

    Each of the ``dialects`` is one scan; columns meet by name, and a file without a column has nulls there. Malformed lines are
    dropped. With ``schema`` its columns come back, in its order; a header that shares no name with it is read by position.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found = dialects(spark, path)
    if not found:
        df = spark.createDataFrame([], fields) if fields else spark.read.option("header", True).csv(path)
        return df.limit(max_rows) if max_rows is not None else df
    parts = []
    for one in found:
        reader = _csv_reader(spark, one).option("mode", "DROPMALFORMED")
        part = (reader.schema(_in_order(one, fields)) if fields else reader.option("inferSchema", True)).csv(path if len(found) == 1 else one.files)
        if one.encoding == "windows-1252":
            names = part.columns if fields else [c.translate(_WINDOWS) for c in part.columns]
            part = part.select(*[_decoded(F.col(f"`{f.name}`"), one.encoding).alias(n) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").alias(n) for f, n in zip(part.schema, names)])
        parts.append(part)
    if fields:
        parts = [p.select(*[F.col(f"`{f.name}`") if f.name in p.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]) for p in parts]
    elif len(parts) > 1:
        parts = _common_types(parts)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.limit(max_rows) if max_rows is not None else df


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested fields as columns with dotted names."""

    def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*prefix, f.name))
            else:
                yield (*prefix, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema)])


def read_json(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """An array of records, an object whose first list of records is the table, one object, or JSON Lines; nested objects are flattened. The order of keys is that of the first file, whole."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    head = lines.agg(F.trim(F.min_by("value", "at")).alias("first"), F.count_distinct(F.col("at.file_path")).alias("files"), F.count("*").alias("lines")).first()
    first_line = head["first"] or ""
    many_lines = first_line.startswith("{") and first_line.endswith("}") and head["lines"] > head["files"]
    df = spark.read.option("multiLine", not many_lines).json(path)
    if not many_lines and first_line.startswith("{"):
        lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if len(lists) > 1:
            whole = spark.read.text(path, wholetext=True).select(F.json_object_keys("value").alias("keys"), F.col("_metadata.file_path").alias("file"))
            ordered = whole.agg(F.min_by("keys", "file").alias("keys")).first()["keys"] or []
            lists.sort(key=lambda n: ordered.index(n) if n in ordered else len(ordered))
        if lists:
            df = df.select(F.explode(F.col(f"`{lists[0]}`")).alias("r")).select("r.*")
    df = flatten_struct(df)
    return df.limit(max_rows) if max_rows is not None else df


def read_parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.limit(max_rows) if max_rows is not None else df


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _elements(stream, tag: str):
    """Each ``tag`` of an XML stream as it ends; what was read is forgotten."""
    events = ElementTree.iterparse(stream, events=("start", "end"))
    open_: list = []
    for event, e in events:
        if event == "start":
            open_.append(e)
            continue
        open_.pop()
        if e.tag == tag:
            yield e
            for parent in open_[-1:]:
                parent.remove(e)


def _sheet_rows(content: bytes, sheet: str | None):
    """Cell texts of one sheet (the first by default) of an .xlsx, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as stream:
                shared = [" ".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in _elements(stream, f"{_MAIN}si")]
        target = None
        if sheet is not None:
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                if s.get("name") == sheet:
                    target = "xl/" + links[s.get(f"{_REL}id")].lstrip("/").removeprefix("xl/")
            if target is None:
                return
        target = target or min(n for n in names if n.startswith("xl/worksheets/sheet"))
        with z.open(target) as stream:
            for r in _elements(stream, f"{_MAIN}row"):
                cells: dict[int, str | None] = {}
                for c in r.iter(f"{_MAIN}c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = len(cells)
                    if letters:
                        at = 0
                        for x in letters[0]:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    value = c.find(f"{_MAIN}v")
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) or None
                    cells[at] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


#: Rows of a workbook that a task sends on at once.
SHEET_ROWS = 1000


def parse_workbooks(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """``(path, row, cells map<string,string>)`` of workbooks ``(path, content)``; the first row names the cells. One task a workbook, of which it holds the file, its shared strings and some rows."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = _sheet_rows(bytes(content), sheet)
                names = next(rows, [])
                start = 0
                while part := list(itertools.islice(rows, SHEET_ROWS)):
                    yield pd.DataFrame({"path": path, "row": range(start, start + len(part)), "cells": [{str(n): v for n, v in zip(names, r) if n is not None} for r in part]})
                    start += len(part)

    return files.select("path", "content").mapInPandas(run, "path string, row bigint, cells map<string,string>")


def read_excel(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sheet: str | None = None, max_rows: int | None = None) -> DataFrame:
    """A folder of .xlsx files, or one; with ``schema`` its columns, else path, row and a map of cells."""
    cells = parse_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), sheet)
    if schema:
        fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
        cells = cells.select(*[F.col("cells")[f.name].try_cast(f.dataType).alias(f.name) for f in fields])
    return cells.limit(max_rows) if max_rows is not None else cells


def read_auto(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension: csv, json, parquet or xlsx; anything else is a ValueError."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "xlsx": read_excel}
    if kind not in readers:
        raise ValueError(f"no reader for {path}")
    return readers[kind](spark, path, **options)


def validate(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """``(file, rows_read, corrupt, is_valid)`` for each file: rows that parse under ``schema`` and those that don't. CSV files are each read by their own dialect."""

    def judged(reader, fields: T.StructType, read) -> DataFrame:
        marked = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
        df = read(reader.schema(marked).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE"))
        # Spark parses only the columns that are asked for, so all of them go into the condition
        bad = F.col("_corrupt").isNotNull() & F.concat("_corrupt", *[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")) for f in fields]).isNotNull()
        return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows_read"), F.count_if(bad).alias("corrupt"))

    fields = T._parse_datatype_string(schema)
    if kind == "csv":
        parts = [judged(_csv_reader(spark, one), _in_order(one, fields), lambda r, one=one: r.csv(one.files)) for one in dialects(spark, path)]
        by = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "file string, rows_read bigint, corrupt bigint")
    else:
        by = judged(spark.read, fields, lambda r: r.json(path))
    return by.withColumn("is_valid", (F.col("rows_read") > 0) & (F.col("corrupt") == 0))


def file_metadata(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """``(format, columns, column_count, row_count, size_bytes, files, delimiters, encodings)`` of a table; of Parquet no data columns are read. ``delimiters`` and ``encodings`` are those found in CSV files, else null."""
    found = dialects(spark, path) if kind == "csv" else []
    tables = [_csv_reader(spark, one).csv(one.files) for one in found] or [spark.read.option("header", True).format(kind).load(path)]
    names = list(dict.fromkeys(n for one in found for n in one.names())) if found else tables[0].columns
    each = reduce(DataFrame.union, [t.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes")) for t in tables])
    listed = lambda values: F.lit(sorted(set(values))).cast("array<string>") if kind == "csv" else F.lit(None).cast("array<string>")
    return each.agg(
        F.lit(kind).alias("format"), F.lit(names).cast("array<string>").alias("columns"), F.lit(len(names)).cast("long").alias("column_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"), F.count("*").alias("files"), listed(d.delimiter for d in found).alias("delimiters"), listed(d.encoding for d in found).alias("encodings"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """``(rows, fingerprint)``: an order-free sum of row digests, as text."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part).cast("string"), F.lit("0")).alias("fingerprint"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def preview_page(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows by ``order``."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
