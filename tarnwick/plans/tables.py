"""Queries: readers and sinks, cleaning, joins, top-k and set operations."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..operators import cleaning
from ..sources import readers, sinks
from .base import MESSY, Section, derived, scratch, table

S = Section()
query = S.query


@query("scan_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    return readers.read_parquet(spark, f"{d}/nation.parquet")


@query("scan_auto", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return readers.read_auto(spark, f"{d}/region.parquet")


@query("scan_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "supplier").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


_HALVES = "SELECT c_custkey, concat('caf\u00e9 ', c_name, ' \u20ac') AS label, c_acctbal FROM customer"


@query("scan_csv_mixed", _HALVES)
def _(spark, d):
    """Customers in three dialects of one folder: commas in UTF-8, semicolons in Windows-1252 with the columns the other way round, tabs in Latin-1 bytes of the same texts without the euro."""
    path = scratch(spark, "csv")
    rows = derived(spark, d, _HALVES)
    rows.where("c_custkey % 3 = 0").write.option("header", True).csv(f"{path}/a")
    odd = rows.where("c_custkey % 3 = 1").select("c_acctbal", F.translate("label", "\u20ac", "\x80").alias("label"), "c_custkey")
    odd.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{path}/b")
    rows.where("c_custkey % 3 = 2").withColumn("label", F.translate("label", "\u20ac", "")).write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").option("ignoreTrailingWhiteSpace", False).csv(f"{path}/c")
    read = readers.read_csv(spark, f"{path}/*", schema="c_custkey bigint, label string, c_acctbal double")
    return read.withColumn("label", F.when(F.col("c_custkey") % 3 == 2, F.concat("label", F.lit("\u20ac"))).otherwise(F.col("label")))


@query("scan_json", """SELECT e.event_id, e.event_type AS "info.kind", e.value AS "info.value" FROM events e""")
def _(spark, d):
    path = scratch(spark, "json")
    table(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), "value").alias("info")).write.json(path)
    return readers.read_json(spark, path).select("event_id", F.col("`info.kind`"), F.col("`info.value`"))


def _workbook(pdf: pd.DataFrame) -> bytes:
    """An .xlsx of texts and numbers, inline."""
    rows = [list(pdf.columns), *pdf.itertuples(index=False)]
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


#: Rows of a workbook on average.
WORKBOOK = 20_000


@query("scan_excel", "SELECT concat('segment/', c_mktsegment) AS path, c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    def pack(key, pdf):
        return pd.DataFrame({"path": [f"segment/{key[0]}"], "content": [_workbook(pdf[["c_custkey", "c_name", "c_acctbal"]])]})

    # a segment is as many workbooks of one path as it takes to hold about WORKBOOK rows each
    customers = table(spark, d, "customer")
    sizes = customers.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.ceil(F.count("*") / WORKBOOK).alias("books"))
    dealt = customers.join(F.broadcast(sizes), F.col("c_mktsegment").eqNullSafe(F.col("segment"))).withColumn("book", F.pmod(F.xxhash64("c_custkey"), "books")).select("c_mktsegment", "book", "c_custkey", "c_name", "c_acctbal")
    books = dealt.groupBy("c_mktsegment", "book").applyInPandas(pack, "path string, content binary")
    cells = readers.parse_workbooks(books)
    return cells.select("path", F.col("cells")["c_custkey"].cast("long").alias("c_custkey"), F.col("cells")["c_name"].alias("c_name"), F.col("cells")["c_acctbal"].cast("double").alias("c_acctbal"))


@query("scan_validate", "SELECT count(*) AS rows_read, CAST(0 AS BIGINT) AS corrupt, TRUE AS is_valid FROM customer")
def _(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name").write.option("header", True).csv(path)
    each = readers.validate(spark, path, "c_custkey bigint, c_name string")
    return each.agg(F.sum("rows_read").alias("rows_read"), F.sum("corrupt").alias("corrupt"), F.min("is_valid").alias("is_valid"))


@query("file_metadata", "SELECT 'parquet' AS format, CAST(11 AS BIGINT) AS column_count, count(*) AS row_count, (SELECT string_agg(column_name, ',') FROM (DESCRIBE SELECT * FROM lineitem)) AS columns FROM lineitem")
def _(spark, d):
    return readers.file_metadata(spark, f"{d}/lineitem.parquet").select("format", "column_count", "row_count", F.array_join("columns", ",").alias("columns"))


@query("dataset_fingerprint", """SELECT count(*) AS rows, CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR), '~'), coalesce(CAST(o_custkey AS VARCHAR), '~'), coalesce(o_orderstatus, '~'), coalesce(o_orderpriority, '~'))), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM orders""")
def _(spark, d):
    return readers.fingerprint(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query("preview_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return readers.preview_page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 3, 50)


@query("report_sink", "SELECT 'b' AS dataset_id, c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'a', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    path = scratch(spark, "report")
    a = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("c_mktsegment")).agg(F.count("*").alias("n"))
    b = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    for report, name in ((b, "a"), (b, "b"), (a, "a")):  # the second report of "a" takes the first one's place
        sinks.write_report(report, path, name)
    return spark.read.parquet(path).select("dataset_id", "c_mktsegment", "n")


@query("normalize_nulls", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events")
def _(spark, d):
    return C.normalize_nulls(derived(spark, d, "SELECT event_id, CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM events"))


@query("select_numeric", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, d):
    return C.select_numeric(table(spark, d, "part"))


@query("coerce_numeric", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", C.coerce_numeric(F.get_json_object("props", "$.k")).alias("k"), C.coerce_numeric(F.col("event_type")).alias("bad"))


@query("coerce_timestamp", "SELECT o_orderkey, epoch_us(o_orderdate) AS us FROM orders")
def _(spark, d):
    texts = derived(spark, d, "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS t FROM orders")
    return C.coerce_timestamp(texts, "t").select("o_orderkey", F.unix_micros("ts").alias("us"))


_GAPPED = "SELECT event_id, event_type, ts, CASE WHEN value > 30 THEN NULL ELSE value END AS value FROM events"


@query("fill_order_gaps", f"""WITH g AS ({_GAPPED}) SELECT event_id, event_type, coalesce(
  first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value FROM g""")
def _(spark, d):
    return cleaning.fill_order_gaps(derived(spark, d, _GAPPED), "value", ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "value")


@query("impute_median", f"WITH m AS ({MESSY}) SELECT order_id, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM m)) AS price FROM m")
def _(spark, d):
    return cleaning.impute(derived(spark, d, MESSY).select("order_id", "price"), ["price"])


@query("impute_mode", f"WITH m AS ({MESSY}) SELECT order_id, coalesce(status, (SELECT status FROM m WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM m")
def _(spark, d):
    return cleaning.impute(derived(spark, d, MESSY).select("order_id", "status"), ["status"], "mode")


@query("impute_constant", f"WITH m AS ({MESSY}) SELECT order_id, coalesce(status, 'missing') AS status FROM m")
def _(spark, d):
    return cleaning.impute(derived(spark, d, MESSY).select("order_id", "status"), ["status"], "constant", "missing")


@query("drop_recommended_columns", f"WITH m AS ({MESSY}) SELECT order_id, price, customer_age FROM m")
def _(spark, d):
    from ..operators import profile, quality

    df = derived(spark, d, MESSY).select("order_id", "price", "channel", "customer_age")
    found = quality.recommendations(quality.missing(profile.detect_schema(df)), quality.constants(df), quality.duplicates(df, []), quality.outliers(df, ["price"]))
    return cleaning.drop_recommended(df, found)


@query("deduplicate", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem")
def _(spark, d):
    return cleaning.deduplicate(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax"))


@query("winsorize", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) AS value FROM events, q""")
def _(spark, d):
    return cleaning.winsorize(table(spark, d, "events").select("event_id", "value"), ["value"]).withColumn("value", F.round("value", 6))


@query("metadata_filter", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return cleaning.metadata_filter(docs, {"lang": "en", "source": "src1"}).select("doc_id", "n_chars")


@query("soft_delete_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, d):
    return cleaning.active(table(spark, d, "orders").withColumn("is_active", F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice")


_OWNED = "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"


@query("owner_filter", _OWNED)
@query("owner_join", _OWNED)
def _(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return cleaning.owned(orders, table(spark, d, "customer"), "c_custkey", F.col("c_mktsegment") == "BUILDING", "o_orderdate").select("o_orderkey", "c_name", "o_totalprice")


@query("document_delete", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    return cleaning.document_delete(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("top_k_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return cleaning.top_k_per_group(rows, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)


@query("top_k_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("rows_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("rows_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("rows_except", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("events_props_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
