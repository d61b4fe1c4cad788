"""What the query modules share: the given tables, derived ones, and the collection of queries with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


class Section:
    """Queries by name, and SQL by name where SQL can say the same."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(function: Query) -> Query:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql``, which names given tables, over those of ``sf_dir``."""
    import re

    names = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    bound = sql
    for t in names:
        bound = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", bound)
    return spark.sql(bound, **{t: table(spark, sf_dir, t) for t in names})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beneath the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Orders as a table with gaps, a constant, ages out of range and bad addresses; the same text in both engines.
MESSY = """
SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, 'web' AS channel, o_orderpriority AS priority,
  CAST(o_custkey % 150 - 5 AS INTEGER) AS customer_age,
  CASE WHEN o_custkey % 10 = 0 THEN 'none' ELSE concat('u', CAST(o_custkey AS STRING), '@shop.org') END AS email,
  CAST(o_orderdate AS DATE) AS placed, CASE WHEN o_custkey % 5 = 0 THEN 'yes' ELSE 'no' END AS repeat_buyer
FROM orders"""
#: (name, kind, Spark type, identifier-like name) of its columns.
MESSY_COLUMNS = [("order_id", "integer", "bigint", True), ("status", "string", "string", False), ("price", "float", "double", False), ("channel", "string", "string", False), ("priority", "string", "string", False), ("customer_age", "integer", "int", False), ("email", "string", "string", True), ("placed", "datetime", "date", False), ("repeat_buyer", "string", "string", False)]
#: Daily series of order values by priority, and of event values by type.
DAILY = "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS y, count(*) AS n FROM orders GROUP BY 1, 2"
EVENT_DAYS = "SELECT event_type AS series, CAST(ts AS DATE) AS day, round(sum(value), 2) AS y, count(*) AS n FROM events GROUP BY 1, 2"
