"""Queries: property graphs over the star schema, and a graph of a table's columns and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import cut, even
from ..operators import explore, graph, profile
from ..sources import sinks
from .base import MESSY, Section, derived, scratch, table
from .models import _REG, versions

S = Section()
query = S.query

_NODES = """SELECT concat('region:', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'REGION' AS node_type, 'geo' AS project_id FROM region
UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), n_name, 'NATION', 'geo' FROM nation
UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), s_name, 'SUPPLIER', 'trade' FROM supplier
UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), c_name, 'CUSTOMER', 'trade' FROM customer"""
_EDGES = """SELECT concat('n', CAST(n_nationkey AS STRING)) AS id, concat('nation:', CAST(n_nationkey AS STRING)) AS source_id, concat('region:', CAST(n_regionkey AS STRING)) AS target_id, 'IN_REGION' AS relation, CAST(1.0 AS DOUBLE) AS weight FROM nation
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('supplier:', CAST(s_suppkey AS STRING)), concat('nation:', CAST(s_nationkey AS STRING)), 'IN_NATION', CAST(1.0 AS DOUBLE) FROM supplier
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('customer:', CAST(c_custkey AS STRING)), concat('nation:', CAST(c_nationkey AS STRING)), 'IN_NATION', CAST(1.0 AS DOUBLE) FROM customer"""
_TRADE = """SELECT concat('customer:', CAST(o_custkey AS STRING)) AS source_id, concat('supplier:', CAST(l_suppkey AS STRING)) AS target_id, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""
_G = f"nodes AS ({_NODES}), edges AS ({_EDGES})"


def nodes(spark, d) -> DataFrame:
    return derived(spark, d, _NODES).withColumn("properties", F.create_map(F.lit("kind"), F.lower("node_type")))


def edges(spark, d) -> DataFrame:
    return derived(spark, d, _EDGES).withColumns({"properties": F.create_map(F.lit("source"), F.lit("keys")), "project_id": F.lit("geo")})


_GEO = "SELECT * FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE node_type IN ('NATION', 'REGION')) AND target_id IN (SELECT id FROM nodes WHERE node_type IN ('NATION', 'REGION'))"


@query("edges_within", f"WITH {_G} SELECT id, source_id, target_id FROM ({_GEO})")
def _(spark, d):
    return graph.edges_within(edges(spark, d), nodes(spark, d).where("node_type in ('NATION', 'REGION')")).select("id", "source_id", "target_id")


_TOUCH = f"WITH {_G} SELECT id, relation FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE project_id = 'trade') OR target_id IN (SELECT id FROM nodes WHERE project_id = 'trade')"


@query("graph_edges", _TOUCH)
@query("edges_touching", _TOUCH)
def _(spark, d):
    return graph.edges_touching(edges(spark, d), graph.select_nodes(nodes(spark, d), "trade")).select("id", "relation")


@query("graph_nodes", f"WITH {_G} SELECT id, name FROM nodes WHERE project_id = 'trade' AND node_type = 'SUPPLIER'")
def _(spark, d):
    return graph.select_nodes(nodes(spark, d), "trade", "SUPPLIER").select("id", "name")


@query("graph_neighbors", f"WITH {_G} SELECT DISTINCT seed, id FROM (SELECT source_id AS seed, target_id AS id FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE seed LIKE 'nation:%'")
def _(spark, d):
    return graph.neighbors(edges(spark, d), nodes(spark, d).where("node_type = 'NATION'").select(F.col("id").alias("seed")))


@query("graph_khop", f"""WITH {_G}, b AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), s AS (SELECT id AS seed FROM nodes WHERE node_type = 'REGION'), h1 AS (SELECT DISTINCT seed, b AS id FROM s JOIN b ON a = seed), h2 AS (SELECT DISTINCT seed, b.b AS id FROM h1 JOIN b ON b.a = h1.id)
SELECT seed, id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT seed, seed AS id, 0 AS hop FROM s UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2) GROUP BY 1, 2""")
def _(spark, d):
    return graph.k_hop(edges(spark, d), nodes(spark, d).where("node_type = 'REGION'").select(F.col("id").alias("seed")), 2)


@query("graph_paths", f"WITH {_G} SELECT c.source_id AS source, n.target_id AS target, round(1 / 3, 4) AS score, CAST(1 AS INTEGER) AS rank FROM edges c JOIN edges n ON c.target_id = n.source_id WHERE c.source_id LIKE 'customer:%'")
def _(spark, d):
    e = edges(spark, d)
    ends = nodes(spark, d).where("node_type = 'CUSTOMER'").select(F.col("id").alias("source")).crossJoin(F.broadcast(nodes(spark, d).where("node_type = 'REGION'").select(F.col("id").alias("target"))))
    return graph.paths(e, ends).select("source", "target", "score", "rank")


_ASK = "SELECT n_nationkey AS query_id, concat('which ', lower(n_name), ' supplier') AS query FROM nation"


@query("graph_search", f"""WITH {_G}, q AS (SELECT query_id, unnest(string_split(query, ' ')) AS word FROM ({_ASK.replace('AS STRING', 'AS VARCHAR')})),
p AS (SELECT q.query_id, n.id, CASE WHEN lower(name) = word THEN 5.0 WHEN contains(lower(name), word) THEN 2.5 WHEN contains(lower(id), word) THEN 1.5 WHEN contains(concat('{{"kind":"', lower(node_type), '"}}'), word) THEN 1.0 END AS s FROM nodes n, q),
t AS (SELECT query_id, id, CAST(sum(s) AS DOUBLE) AS score FROM p WHERE s IS NOT NULL GROUP BY 1, 2) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t) WHERE rank <= 10""")
def _(spark, d):
    return graph.search_nodes(nodes(spark, d), derived(spark, d, _ASK))


@query("graph_metrics", f"WITH {_G} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 6) AS density, (SELECT count(*) FROM region) AS components, (SELECT count(*) FROM region) = 1 AS is_connected")
def _(spark, d):
    return graph.metrics(nodes(spark, d), edges(spark, d))


@query("graph_distributions", f"WITH {_G} SELECT 'node_type' AS kind, node_type AS value, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY 2")
def _(spark, d):
    return graph.distributions(nodes(spark, d), edges(spark, d))


#: As many rounds as SQL counts; the query ends before the last of them, where the change is under a millionth a node.
_ROUNDS = 60
_RANKS = ", ".join(f"r{k} AS MATERIALIZED (SELECT n.id, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(x), 0) FROM r{k - 1} WHERE id NOT IN (SELECT id FROM li)) / (SELECT count(*) FROM ids)) + 0.15 / (SELECT count(*) FROM ids) AS x FROM ids n LEFT JOIN (SELECT t AS id, sum(r.x * li.s) AS got FROM li JOIN r{k - 1} r ON r.id = li.id GROUP BY 1) g ON g.id = n.id)" for k in range(1, _ROUNDS + 1))
_MOVED = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.x - b.x)) AS moved FROM r{k} a JOIN r{k - 1} b USING (id)" for k in range(1, _ROUNDS + 1))
_EVERY = " UNION ALL ".join(f"SELECT {k} AS k, id, x FROM r{k}" for k in range(1, _ROUNDS + 1))


def trade(spark, d) -> DataFrame:
    """The rows of ``_TRADE``, joined and added up by numbers in parts of like size."""
    lines, orders = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = lines.count()
    met = even(lines, n, "l_orderkey").join(even(orders, n, "o_orderkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = even(met.select("o_custkey", "l_suppkey", "l_quantity"), n, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("weight"))
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return sums.select(named("customer", "o_custkey").alias("source_id"), named("supplier", "l_suppkey").alias("target_id"), "weight")


@query("graph_pagerank", f"""WITH tr AS MATERIALIZED ({_TRADE.replace('AS STRING', 'AS VARCHAR')}), ids AS MATERIALIZED (SELECT DISTINCT source_id AS id FROM tr UNION SELECT DISTINCT target_id FROM tr), li AS MATERIALIZED (SELECT source_id AS id, target_id AS t, weight / sum(weight) OVER (PARTITION BY source_id) AS s FROM tr),
r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM ids) AS x FROM ids), {_RANKS}, mo AS MATERIALIZED ({_MOVED}) SELECT id, round(x, 9) AS rank FROM ({_EVERY}) WHERE k = (SELECT min(k) FROM mo WHERE moved < 1e-6 * (SELECT count(*) FROM ids))""")
def _(spark, d):
    links = cut(trade(spark, d))
    ids = links.select(F.col("source_id").alias("id")).union(links.select("target_id")).distinct()
    return graph.pagerank(ids, links).select("id", F.round("rank", 9).alias("rank"))


@query("graph_facts", f"WITH {_G} SELECT e.id, concat('''', a.name, ''' ', relation, ' ''', b.name, '''.') AS fact FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id")
def _(spark, d):
    return graph.facts(edges(spark, d), nodes(spark, d))


@query("graph_query")
def _(spark, d):
    return graph.question(nodes(spark, d), edges(spark, d), derived(spark, d, _ASK))


@query("graph_delete", f"WITH {_G} SELECT (SELECT count(*) FROM nodes WHERE project_id <> 'trade') AS nodes, (SELECT count(*) FROM ({_GEO})) AS edges")
def _(spark, d):
    n, e = graph.clear(nodes(spark, d), edges(spark, d), "trade")
    return n.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(e.agg(F.count("*").alias("edges"))))


@query("graph_upsert", f"WITH {_G} SELECT id, CASE WHEN node_type = 'NATION' THEN lower(name) ELSE name END AS name FROM nodes")
def _(spark, d):
    old = nodes(spark, d).select("id", "name").withColumn("version", F.lit(1))
    new = nodes(spark, d).where("node_type = 'NATION'").select("id", F.lower("name").alias("name")).withColumn("version", F.lit(2))
    return graph.upsert(old, new).select("id", "name")


def _saved(spark, d) -> tuple[DataFrame, DataFrame]:
    path = scratch(spark, "graph")
    sinks.save_graph(nodes(spark, d), edges(spark, d), path)
    return sinks.load_graph(spark, path)


@query("graph_save", f"WITH {_G} SELECT project_id, count(*) AS nodes FROM nodes GROUP BY 1")
def _(spark, d):
    return _saved(spark, d)[0].groupBy("project_id").agg(F.count("*").alias("nodes"))


@query("graph_load", f"WITH {_G} SELECT id, source_id, target_id, relation FROM edges")
def _(spark, d):
    return _saved(spark, d)[1].select("id", "source_id", "target_id", "relation")


_SELECTED = "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem"


@query("graph_from_table", """WITH p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 3) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 3) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 3) FROM lineitem)
SELECT concat('dataset:line|HAS_COLUMN|column:line:', c) AS id, CAST(1.0 AS DOUBLE) AS weight FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_returnflag')) v(c) UNION ALL SELECT concat('column:line:', a, '|CORRELATES_WITH|column:line:', b), abs(r) FROM p WHERE abs(r) >= 0.25
UNION ALL SELECT 'column:line:l_returnflag|TARGET_OF|problem:line:l_returnflag', 1.0 UNION ALL SELECT 'problem:line:l_returnflag|BELONGS_TO|dataset:line', 1.0""")
def _(spark, d):
    df = derived(spark, d, _SELECTED)
    found = graph.from_table(profile.detect_schema(df), explore.correlations(df, ["l_quantity", "l_extendedprice", "l_discount"]), "line", "l_returnflag")
    return found[1].select("id", "weight")


@query("graph_from_models", f"WITH {_REG} SELECT concat('model:', version_id) AS id, name, 'MODEL' AS node_type FROM reg UNION ALL SELECT concat('metric:', version_id, ':accuracy'), concat('accuracy = ', CAST(accuracy AS VARCHAR)), 'METRIC' FROM reg UNION ALL SELECT concat('metric:', version_id, ':rmse'), concat('rmse = ', CAST(rmse AS VARCHAR)), 'METRIC' FROM reg")
def _(spark, d):
    return graph.from_models(versions(spark, d), "orders", "status")[0].select("id", "name", "node_type")


@query("graph_from_reports", "SELECT concat('dataset:events|HAS_ANOMALY|anomaly:events:', event_type) AS id FROM events GROUP BY event_type UNION ALL SELECT concat('dataset:events|HAS_FORECAST|forecast:events:', event_type) FROM events GROUP BY event_type")
def _(spark, d):
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("series")).agg(F.count_if(F.col("value") > 50).alias("anomalies"))
    return graph.from_reports(by, by.select("series", F.lit("naive").alias("method"), F.lit(7).alias("horizon")), "events")[1].select("id")


_TERMS = "SELECT DISTINCT concat('term:', lang) AS id, CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'und' WHEN 'fr' THEN 'les' ELSE 'del' END AS name FROM documents WHERE lang IS NOT NULL"
_MENTIONS = f"WITH t AS ({_TERMS}), w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM documents) SELECT doc_id, id FROM w, t WHERE list_contains(w, name)"


@query("mention_join", _MENTIONS)
def _(spark, d):
    return graph.mentions(table(spark, d, "documents"), derived(spark, d, _TERMS), "doc_id", "text")


@query("graph_from_text", f"SELECT concat('document:', doc_id, '|MENTIONS|', id) AS id, CAST(0.8 AS DOUBLE) AS weight FROM ({_MENTIONS})")
def _(spark, d):
    return graph.from_text(table(spark, d, "documents"), derived(spark, d, _TERMS), "doc_id", "text", "source")[1].select("id", "weight")
