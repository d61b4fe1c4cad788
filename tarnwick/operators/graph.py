"""Property graphs as two tables: building, upserts, neighbourhoods, paths, search, metrics, PageRank, facts.

``nodes``: id, name, node_type, project_id, properties map. ``edges``: id, source_id, target_id, relation,
weight, properties map, project_id. Ids are strings. Loops cut their lineage by reliable checkpoints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import cut as _cut, even, few
from ..functions.substrings import containing


def _empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def _node(df: DataFrame, id_: Column, name: Column, kind: str, **properties: Column) -> DataFrame:
    held = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]) if properties else _empty()
    return df.select(id_.alias("id"), name.alias("name"), F.lit(kind).alias("node_type"), held.alias("properties"))


def _edge(df: DataFrame, source: Column, target: Column, relation: str, weight: Column, **properties: Column) -> DataFrame:
    held = F.create_map(*[x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]) if properties else _empty()
    return df.select(F.concat(source, F.lit(f"|{relation}|"), target).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(relation).alias("relation"), weight.cast("double").alias("weight"), held.alias("properties"))


def from_table(schema: DataFrame, pairs: DataFrame, dataset: str, target: str | None = None, problem: str = "classification", least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Dataset, column and problem nodes; HAS_COLUMN, CORRELATES_WITH (|r| of ``least`` or more), TARGET_OF and BELONGS_TO edges, from a schema report and correlations."""
    ds, col = F.lit(f"dataset:{dataset}"), lambda c: F.concat(F.lit(f"column:{dataset}:"), F.col(c))
    one = schema.sparkSession.range(1)
    nodes = [_node(one, ds, F.lit(dataset), "DATASET"), _node(schema, col("column"), F.col("column"), "COLUMN", inferred_type=F.col("inferred_type"), data_type=F.col("dtype"))]
    size = F.abs("r")
    strength = F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak")
    edges = [_edge(schema, ds, col("column"), "HAS_COLUMN", F.lit(1.0)), _edge(pairs.where(size >= least), col("column_a"), col("column_b"), "CORRELATES_WITH", size, correlation_r=F.col("r"), strength=strength)]
    if target:
        p, t = F.lit(f"problem:{dataset}:{target}"), F.lit(f"column:{dataset}:{target}")
        nodes.append(_node(one, p, F.lit(f"Predict {target}"), "ML_PROBLEM", problem_type=F.lit(problem)))
        edges += [_edge(one, t, p, "TARGET_OF", F.lit(1.0)), _edge(one, p, ds, "BELONGS_TO", F.lit(1.0))]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def from_models(registry: DataFrame, dataset: str, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Model and metric nodes of ``(version_id, name, algorithm, metrics map)``; TRAINED_ON, TARGET_OF and ACHIEVED_METRIC edges, weighted by the metric within 0 to 1, or 0.5 for losses and errors. Metrics that aren't finite are left out."""
    model = F.concat(F.lit("model:"), "version_id")
    m = registry.select("version_id", F.explode("metrics").alias("metric", "value")).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    metric = F.concat(F.lit("metric:"), "version_id", F.lit(":"), "metric")
    nodes = _node(registry, model, F.col("name"), "MODEL", algorithm=F.col("algorithm")).unionByName(_node(m, metric, F.concat("metric", F.lit(" = "), F.round("value", 4).cast("string")), "METRIC", value=F.col("value")))
    weight = F.when(F.col("metric").rlike("(?i)loss|error|mae|mse"), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value"))))
    edges = [_edge(registry, model, F.lit(f"dataset:{dataset}"), "TRAINED_ON", F.lit(1.0)), _edge(m, model, metric, "ACHIEVED_METRIC", weight)]
    if target:
        edges.append(_edge(registry, F.lit(f"problem:{dataset}:{target}"), model, "TARGET_OF", F.lit(1.0)))
    return nodes, reduce(DataFrame.unionByName, edges)


def from_reports(anomalies: DataFrame, forecasts: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and HAS_ANOMALY, HAS_FORECAST edges of ``anomalies(series, anomalies)`` and ``forecasts(series, horizon, method)``."""
    ds = F.lit(f"dataset:{dataset}")
    a, f = F.concat(F.lit(f"anomaly:{dataset}:"), "series"), F.concat(F.lit(f"forecast:{dataset}:"), "series")
    nodes = _node(anomalies, a, F.concat(F.lit("Anomalies of "), "series"), "ANOMALY", count=F.col("anomalies")).unionByName(_node(forecasts, f, F.concat(F.lit("Forecast of "), "series"), "FORECAST", method=F.col("method"), horizon=F.col("horizon")))
    edges = _edge(anomalies, ds, a, "HAS_ANOMALY", F.lit(1.0), count=F.col("anomalies")).unionByName(_edge(forecasts, ds, f, "HAS_FORECAST", F.lit(1.0)))
    return nodes, edges


def mentions(docs: DataFrame, nodes: DataFrame, key: str, text: str, most_words: int = 4) -> DataFrame:
    """``(key, id)``: nodes whose name, of 3 letters or more and up to ``most_words`` words, stands in the text as whole words; word n-grams of both sides meet in an equi-join. Names of more words are met by their first ``most_words`` and then looked for in those texts."""
    normal = lambda c: F.array_join(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != ""), " ")
    named = nodes.where(F.length("name") >= 3).select("id", normal(F.col("name")).alias("gram")).where("gram <> ''")
    long = F.size(F.split("gram", " ")) > most_words
    words = docs.select(F.col(key).alias("k"), F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("w"))
    sizes = [r["n"] for r in named.where(~long).select(F.size(F.split("gram", " ")).alias("n")).distinct().collect()]
    none = F.array().cast("array<string>")

    def grams_of(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).otherwise(none)

    grams = F.flatten(F.array(*[grams_of(n) for n in sorted(sizes)])) if sizes else none
    found = words.select("k", F.explode(F.array_distinct(grams)).alias("gram")).join(named.where(~long), "gram").select("k", "id")
    rest = named.where(long)
    if not rest.isEmpty():
        # longer names are met by their first words, and then looked for in the text
        first = F.array_join(F.slice(F.split("gram", " "), 1, most_words), " ")
        seeded = words.select("k", "w", F.explode(F.array_distinct(grams_of(most_words))).alias("seed")).join(rest.withColumn("seed", first), "seed")
        body = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
        found = found.union(seeded.where(F.contains(body, F.concat(F.lit(" "), F.col("gram"), F.lit(" ")))).select("k", "id"))
    return found.distinct().withColumnRenamed("k", key)


def from_text(docs: DataFrame, nodes: DataFrame, key: str, text: str, title: str) -> tuple[DataFrame, DataFrame]:
    """Document nodes and MENTIONS edges of weight 0.8."""
    doc = F.concat(F.lit("document:"), F.col(key).cast("string"))
    return _node(docs, doc, F.col(title), "DOCUMENT"), _edge(mentions(docs, nodes, key, text), doc, F.col("id"), "MENTIONS", F.lit(0.8))


def upsert(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Of each id the row with the highest ``version``; of equal ones the new table's."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return both.withColumn("r_", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(version), F.desc("new_")))).where("r_ = 1").drop("r_", "new_")


def select_nodes(nodes: DataFrame, project: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes of a project (or of none) and type."""
    if project is not None:
        nodes = nodes.where((F.col("project_id") == project) | F.col("project_id").isNull())
    return nodes if kind is None else nodes.where(F.col("node_type") == kind)


def edges_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def edges_touching(edges: DataFrame, ids: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges with either end among ``ids(id)``."""
    ids = ids.select("id").distinct()
    rows = edges if relation is None else edges.where(F.col("relation") == relation)
    a = rows.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("a_")), "source_id", "left")
    both = a.join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("b_")), "target_id", "left")
    return both.where("a_ or b_").select(*edges.columns)


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """``(seed, id)`` for ``seeds(seed)``: ends of edges out of, into, or at a seed."""
    out = seeds.join(edges.select(F.col("source_id").alias("seed"), F.col("target_id").alias("id")), "seed")
    into = seeds.join(edges.select(F.col("target_id").alias("seed"), F.col("source_id").alias("id")), "seed")
    return {"out": out, "in": into}.get(direction, out.union(into)).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``(seed, id, hop)``: what each seed reaches within ``hops`` steps either way, itself at 0, all seeds at once."""
    both = edges.select("source_id", "target_id").union(edges.select("target_id", "source_id")).toDF("id", "next").distinct()
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop"))
    edge = seen
    for hop in range(1, hops + 1):
        new = edge.join(both, "id").select("seed", F.col("next").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        edge = new.withColumn("hop", F.lit(hop))
        seen = seen.unionByName(edge)
    return seen


def _steps_left(step: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``(target, next, left)``: nodes from which a target can be reached, and in how many steps at least; up to ``most`` of them."""
    seen = edge = targets.select("target", F.col("target").alias("next"), F.lit(0).alias("left"))
    for left in range(1, most + 1):
        back = edge.join(step, "next").select("target", F.col("at").alias("next")).distinct()
        edge = _cut(back.join(seen.select("target", "next"), ["target", "next"], "left_anti").withColumn("left", F.lit(left)))
        seen = seen.union(edge)
    return _cut(seen)


def paths(edges: DataFrame, pairs: DataFrame, most: int = 3, k: int = 5) -> DataFrame:
    """``(source, target, path, score, rank)``: the ``k`` first directed simple paths of up to ``most`` edges for ``pairs(source, target)``, by length, then ids; score 1 / nodes.

    The search is two-sided: steps left to each target are found backwards, node by node, and walks from the sources only go on
    to nodes from which their target is near enough. A pair with ``k`` paths goes no further, as longer ones rank behind.
    A pair of a node with itself, or with a null, has no path.
    """
    pairs = pairs.select("source", "target").where("source <> target").distinct()
    step = _cut(edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next")).where("at is not null and next is not null and at <> next").distinct())
    near = _steps_left(step, pairs.select("target").distinct(), most - 1)
    walk = pairs.select("source", "target", F.array("source").alias("path"), F.col("source").alias("at"))
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy("path"))
    found = None
    for taken in range(1, most + 1):
        on = walk.join(step, "at").where(~F.array_contains("path", F.col("next"))).join(near.where(F.col("left") <= most - taken), ["target", "next"])
        walk = _cut(on.select("source", "target", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")))
        ends = walk.where("at = target").withColumn("nth", rank).where(F.col("nth") <= k).select("source", "target", "path")
        found = _cut(ends if found is None else found.union(ends))
        full = found.groupBy("source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        walk = walk.where("at <> target").join(full, ["source", "target"], "left_anti")
    every = found.select("source", "target", "path", F.round(1 / F.size("path"), 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.size("path"), "path"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def search_nodes(nodes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, id, score, rank)``: for each word of the query 5 if it is the name, 2.5 if in the name, 1.5 if in the id, 1 if in the properties; ties by id. The queries are a set against all nodes."""
    asked = queries.select("query_id", F.explode(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "")).alias("word"))
    body = nodes.select("id", F.lower("name").alias("name"), F.lower("id").alias("low"), F.lower(F.to_json("properties")).alias("props"))
    c = F.contains
    points = F.when(F.col("name") == F.col("word"), 5.0).when(c("name", "word"), 2.5).when(c("low", "word"), 1.5).when(c("props", "word"), 1.0)
    whole = body.select("id", F.concat("name", F.lit(" "), "low", F.lit(" "), "props").alias("whole"))
    hit = containing(whole, "id", "whole", asked, "word").join(body, "id").join(asked, "word").withColumn("points", points).where("points is not null")
    scored = hit.groupBy("query_id", "id").agg(F.sum("points").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id weakly connected, by passing on least labels and jumping over them until nothing changes."""
    ids = nodes.select("id").distinct()
    both = _cut(edges_within(edges, ids).select("source_id", "target_id").union(edges_within(edges, ids).select("target_id", "source_id")).toDF("id", "next").distinct())
    labels = ids.withColumn("component", F.col("id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "next"), "next").groupBy("id").agg(F.min("component").alias("least"))
        low = labels.join(near, "id", "left").select("id", F.least("component", "least").alias("new"), "component")
        jump = low.join(low.select(F.col("id").alias("new"), F.col("new").alias("far")), "new", "left").select("id", F.least("new", "far").alias("new"), "component")
        jump = _cut(jump)
        labels = jump.select("id", F.col("new").alias("component"))
        if jump.where("new <> component").isEmpty():
            return labels


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(nodes, edges, density, components, is_connected)`` over the edges within the nodes."""
    own = edges_within(edges, nodes)
    n = nodes.agg(F.count_distinct("id").alias("nodes"))
    parts = components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    one = n.crossJoin(F.broadcast(own.agg(F.count("*").alias("edges")))).crossJoin(F.broadcast(parts))
    return one.select("nodes", "edges", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 6).alias("density"), "components", (F.col("components") == 1).alias("is_connected"))


def distributions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, value, count)`` of node types and relations."""
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), "value", "count")
    return count(nodes, "node_type", "node_type").union(count(edges, "relation", "relation"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``(id, rank)``: weighted links, parallel ones added up, the mass of nodes without links spread over all; ends when the change is under ``tolerance`` a node.

    Nodes go by numbers, and no links are sorted: a task of a round holds its nodes and the sums of the targets it meets.
    """
    ids = few(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(None).cast("double").alias("rank"))
    end = lambda c, to: ids.select(F.col("id").alias(c), F.col("n").alias(to))
    links = _cut(edges.select("source_id", "target_id", "weight").join(end("source_id", "from"), "source_id").join(end("target_id", "to"), "target_id").select("from", "to", "weight"))
    links = _cut(even(links, links.count(), "from", "to").groupBy("from", "to").agg(F.sum("weight").alias("w")).where("w > 0"))
    # links lie by their source once and for all; a round moves only what each task sums up for a target
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = links.groupBy(F.col("from").alias("n")).agg(F.sum("w").alias("all"))
    ranks = _cut(ids.select("n").join(out, "n", "left").select("n", "all", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved")))
    links = links.repartition(parts, "from").persist()
    loose = ranks.where("all is null").count() / n
    for k in range(rounds):
        given = links.join(ranks.select(F.col("n").alias("from"), "rank", "all").repartition(parts, "from").hint("shuffle_hash"), "from").groupBy(F.col("to").alias("n")).agg(F.sum(F.col("rank") * (F.col("w") / F.col("all"))).alias("got"))
        new = damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n)) + (1 - damping) / n
        ranks = _cut(ranks.join(given, "n", "left").select("n", "all", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        moved, loose = ranks.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("all").isNull(), F.col("rank"))), F.lit(0.0))).first()
        if moved < n * tolerance:
            break
    links.unpersist()
    return ranks.join(ids, "n").select("id", "rank")


#: The sentence of each relation.
FACTS = {
    "HAS_COLUMN": "Dataset '%s' includes feature '%s'.",
    "TARGET_OF": "'%s' is targeted by '%s'.",
    "TRAINED_ON": "Model '%s' was trained on dataset '%s'.",
    "ACHIEVED_METRIC": "Model '%s' achieved performance metric '%s'.",
    "HAS_ANOMALY": "Dataset '%s' has detected anomalies: '%s'.",
    "HAS_FORECAST": "Dataset '%s' has projected time-series forecasts: '%s'.",
    "MENTIONS": "Document '%s' references domain concept '%s'.",
}


def facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, fact)``: a sentence for each edge; ends without a node go by their id."""
    name = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(end))
    rows = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left").withColumns({"source": F.coalesce("source", "source_id"), "target": F.coalesce("target", "target_id")})
    r = F.coalesce(F.element_at("properties", F.lit("correlation_r")), F.col("weight").cast("string"))
    out = F.when(F.col("relation") == "CORRELATES_WITH", F.format_string("Feature '%s' correlates with '%s' (Pearson r = %s).", "source", "target", r))
    for relation, sentence in FACTS.items():
        out = out.when(F.col("relation") == relation, F.format_string(sentence, "source", "target"))
    return rows.select("id", out.otherwise(F.format_string("'%s' %s '%s'.", "source", "relation", "target")).alias("fact"))


def question(nodes: DataFrame, edges: DataFrame, queries: DataFrame, hops: int = 2, seeds: int = 4) -> DataFrame:
    """``(query_id, kind, content)``: entities found for each question, facts of the edges among what they reach, and paths between them."""
    found = _cut(search_nodes(nodes, queries, seeds))  # a few rows a question, read six times
    reach = k_hop(edges, found.select(F.col("id").alias("seed")).distinct(), hops)
    area = found.select("query_id", F.col("id").alias("seed")).join(reach, "seed").select("query_id", "id").distinct()
    area = _cut(area)
    ends = edges.join(area.select("query_id", F.col("id").alias("source_id")), "source_id")
    inner = ends.join(area.select("query_id", F.col("id").alias("target_id")), ["query_id", "target_id"], "left_semi")
    told = inner.select("query_id", "id").join(facts(edges, nodes), "id").select("query_id", F.lit("fact").alias("kind"), F.col("fact").alias("content"))
    a = found.select("query_id", F.col("id").alias("source"))
    ways = paths(edges, a.join(found.select("query_id", F.col("id").alias("target")), "query_id").where("source <> target").select("source", "target").distinct())
    routes = a.join(found.select("query_id", F.col("id").alias("target")), "query_id").join(ways, ["source", "target"]).select("query_id", F.lit("path").alias("kind"), F.array_join("path", " -> ").alias("content"))
    return found.select("query_id", F.lit("entity").alias("kind"), F.col("id").alias("content")).union(told).union(routes)


def clear(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a project's nodes and the edges that touch them."""
    gone = nodes.where(F.col("project_id") == project).select("id")
    kept = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept, left.select(*edges.columns)
