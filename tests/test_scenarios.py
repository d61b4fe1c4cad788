"""Small tables with known answers for the operators."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tarnwick.functions import columns as C
from tarnwick.operators import anomaly, cleaning, drift, explore, forecast, graph, ml, profile, quality, registry, retrieval, text, timeseries as ts
from tarnwick.sources import readers
from tarnwick.streaming import anomalies as streaming


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def days(n, start=datetime.date(2024, 1, 1)):
    return [start + datetime.timedelta(days=i) for i in range(n)]


def series(spark, values):
    return spark.createDataFrame([("s", d, float(v)) for d, v in zip(days(len(values)), values)], "series string, day date, y double")


def test_schema_types(spark):
    data = [(f"c{i}", 20 + i % 40, i % 2 == 0, f"2024-01-{i % 28 + 1:02d}", "abc"[i % 3], "a long note about customer number %d and more words" % i) for i in range(100)]
    df = spark.createDataFrame(data, "customer_id string, age long, is_active boolean, signup_date string, tier string, notes string")
    found = {r["column"]: r["inferred_type"] for r in profile.detect_schema(df).collect()}
    assert found == {"customer_id": "IDENTIFIER", "age": "NUMERICAL", "is_active": "BOOLEAN", "signup_date": "DATETIME", "tier": "CATEGORICAL", "notes": "TEXT"}


def test_schema_of_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a string, b double")
    assert {r["inferred_type"] for r in profile.detect_schema(df).collect()} == {"UNKNOWN"}
    assert profile.detect_schema(df.limit(0)).count() == 2


def test_profile_mean(spark):
    df = spark.createDataFrame([(70000, "a"), (80000, "b"), (85000, "a"), (90000, "c"), (100000, "a")], "salary long, department string")
    r = profile.profile_numeric(df, ["salary"]).first()
    assert (r["mean"], r["min"], r["max"], r["median"]) == (85000.0, 70000.0, 100000.0, 85000.0)
    top = rows(profile.top_values(df, ["department"]).select("rank", "value", "count", "cardinality"), "rank")
    assert top == [(1, "a", 3, 3), (2, "b", 1, 3), (3, "c", 1, 3)]


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    found = rows(profile.histogram(df, ["x"], 10).where("count > 0").select("bin", "count"))
    assert found == [(5, 4)]


def test_quality_faults(spark):
    df = spark.createDataFrame([(1, -5, 50000, "x", 1.0), (2, 30, 52000, "x", None), (3, 150, 51000, "x", 2.0), (4, 40, 900000, "x", None), (4, 41, 53000, "x", 3.0)], "id long, age long, income long, constant_col string, nullable_feat double")
    assert quality.duplicates(df, ["id"]).first()["duplicate_rows"] == 1
    assert [r["column"] for r in quality.constants(df).where("kind = 'constant'").collect()] == ["constant_col"]
    assert quality.invalid(df, quality.default_rules(df.columns)).first()["invalid_count"] == 2
    assert [r["column"] for r in quality.outliers(df, ["income"]).collect()] == ["income"]
    m = quality.missing(profile.detect_schema(df)).first()
    assert (m["column"], m["null_pct"], m["severity"]) == ("nullable_feat", 40.0, "CRITICAL")


@pytest.mark.parametrize("counts,want", [((1000, 0, 100, 0, 0, 0, 10, 0), (100.0, 100.0, "A")), ((1000, 100, 100, 0, 0, 0, 10, 0), (90.0, 96.5, "A"))])
def test_score(spark, counts, want):
    names = "total_cells long, total_nulls long, total_rows long, duplicate_rows long, invalid_cells long, constant_columns long, total_columns long, outlier_cells long"
    r = quality.score(spark.createDataFrame([counts], names)).first()
    assert (r["completeness"], r["overall_score"], r["grade"]) == want


def test_perfect_correlations(spark):
    df = spark.createDataFrame([(i, 2 * i, 10 - i, 1) for i in range(1, 6)], "revenue long, ad_spend long, satisfaction long, flat long")
    found = {(a, b): r for a, b, r in rows(explore.correlations(df, df.columns))}
    assert found["revenue", "ad_spend"] == 1.0 and found["revenue", "satisfaction"] == -1.0 and found["revenue", "flat"] == 0.0


def test_lags_and_rolling_see_the_past_only(spark):
    df = series(spark, range(1, 41))
    out = ts.rolling(ts.lags(df, ["series"], "day", ["y"]), ["series"], "day", "y").orderBy("day").collect()
    assert out[10]["y_lag_1"] == 10.0 and out[0]["y_lag_1"] is None
    assert out[10]["roll_mean_7"] == pytest.approx(sum(range(4, 11)) / 7)


def test_trend_and_season(spark):
    df = series(spark, [100 + 2.5 * i + 20 * math.sin(2 * math.pi * i / 7) for i in range(56)])
    assert ts.trend(df, ["series"], "day", "y").first()["trend"] == "UPWARD"
    flat = series(spark, [100 + 20 * math.sin(2 * math.pi * i / 7) for i in range(56)])
    assert ts.seasonality(flat, ["series"], "day", "y").first()["period"] % 7 == 0
    p = ts.temporal_profile(df, ["series"], "day").first()
    assert (p["frequency"], p["regular"], p["missing_intervals"]) == ("1D", True, 0)


def test_sequences(spark):
    out = ts.sequences(series(spark, [math.sin(i) for i in range(50)]), ["series"], "day", "y", 10, 3)
    assert out.count() == 50 - 10 - 3 + 1


@pytest.mark.parametrize("method", sorted(forecast.METHODS))
def test_forecast_lengths(spark, method):
    df = series(spark, [50 + 3 * i + 10 * math.sin(2 * math.pi * i / 7) for i in range(45)])
    out = rows(forecast.METHODS[method](df, ["series"], "day", "y", 7).select("step", "forecast"), "step")
    assert [s for s, _ in out] == list(range(1, 8)) and all(math.isfinite(v) for _, v in out)


def test_holt_winters_follows_trend_and_season(spark):
    values = [50 + 3 * i + 10 * math.sin(2 * math.pi * i / 7) for i in range(70)]
    out = rows(forecast.solved(series(spark, values[:63]), ["series"], "day", "y", 7, "holt_winters").select("step", "forecast"), "step")
    assert all(abs(v - values[63 + s - 1]) < 12 for s, v in out)


def test_intervals_are_nested(spark):
    f = spark.createDataFrame([("s", i, 10.0 * i) for i in range(1, 6)], "series string, step int, forecast double")
    r = spark.createDataFrame([("s", float(x)) for x in (-1, 1, -2, 2, 0)], "series string, residual double")
    for x in forecast.intervals(f, r, ["series"]).collect():
        assert x["low_95"] < x["low_80"] < x["forecast"] < x["high_80"] < x["high_95"]


def test_metrics(spark):
    pairs = spark.createDataFrame([("s", a, b) for a, b in ((100.0, 101.0), (110.0, 108.0), (120.0, 121.0), (130.0, 131.0), (140.0, 139.0))], "series string, actual double, forecast double")
    m = forecast.metrics(pairs, ["series"]).first()
    assert m["r2"] > 0.9 and m["mape"] < 5


SPIKE = [100, 102, 99, 101, 103, 500, 101, 100, 102]


def test_spike_is_found(spark):
    df = series(spark, SPIKE)
    for out, flag in ((anomaly.zscore(df, ["series"], "y", 2.0), "zscore_flag"), (anomaly.modified_zscore(df, ["series"], "y"), "mad_flag"), (anomaly.iqr(df, ["series"], "y"), "iqr_flag")):
        assert [r["y"] for r in out.where(flag).collect()] == [500.0]


def test_level_shift_and_critical_sensor(spark):
    values = [60 + (i * 7 % 5) * 0.2 + (12 if i >= 40 else 0) for i in range(60)]
    values[20] = 105
    df = series(spark, values).withColumn("metric", F.lit("temperature"))
    points = anomaly.change_points(df, ["series"], "day", "y").collect()
    assert any(35 <= (p["day"] - datetime.date(2024, 1, 1)).days <= 45 and p["direction"] == "UP" for p in points)
    worst = anomaly.consensus(df, ["series"], "day", "y", "metric").where("severity = 'CRITICAL'").collect()
    assert 105.0 in [r["y"] for r in worst]


def test_isolation_forest_ranks_the_far_point(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(200)] + [(999, 100.0, -80.0)], "id long, a double, b double")
    out = anomaly.isolation_forest(df, "id", ["a", "b"], trees=40)
    assert out.orderBy(F.desc("isolation_score")).first()["id"] == 999
    assert out.where("isolation_score < 0 or isolation_score > 1").count() == 0


def test_reconstruction_flags_a_share(spark):
    df = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 2 + F.when(F.col("id") == 7, 50).otherwise(0)).cast("double").alias("b"))
    out = anomaly.reconstruction(df, ["a", "b"])
    assert out.where("reconstruction_flag").count() <= 10 and out.where("id = 7").first()["reconstruction_flag"]


def test_drift(spark):
    a = spark.range(500).select((F.col("id") % 50).cast("double").alias("m"), (F.col("id") % 7).cast("double").alias("n"))
    b = a.select((F.col("m") + 20).alias("m"), "n")
    found = {r["column"]: r["alert"] for r in drift.report(a, b).collect()}
    assert found == {"m": True, "n": False}
    assert drift.overall(drift.report(a, a)).first()["alert"] is False


def test_registry(spark):
    events = spark.createDataFrame([("m", 1, "a", {"accuracy": 0.88, "loss": 0.4}), ("m", 2, "b", {"accuracy": 0.94, "loss": 0.3})], "model_id string, created_at int, version_id string, metrics map<string,double>")
    reg = registry.register(events)
    assert [r["version_tag"] for r in reg.orderBy("version_id").collect()] == ["v1", "v2"]
    compared = registry.compare(reg, spark.createDataFrame([("a", "b")], "a string, b string"))
    assert registry.winners(compared).first()["winner"] == "b"
    assert rows(registry.lineage(reg).where("version_id = 'b'").select("depth", "ancestor"), "depth") == [(0, "b"), (1, "a")]
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "version_id string, parent_id string")
    assert registry.lineage(loop).count() == 4


def test_leakage(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2, float(i % 2) * 3, float(i * 7 % 5)) for i in range(100)], "customer_id long, churn long, churn_flag long, copy double, fine double")
    found = {(r["column"], r["risk"]) for r in ml.leakage(df, "churn").collect()}
    assert ("churn_flag", "TARGET_DERIVED_FEATURE") in found and ("customer_id", "UNIQUE_IDENTIFIER") in found and ("copy", "NEAR_PERFECT_CORRELATION") in found
    assert not [c for c, _ in found if c == "fine"]


def test_leakage_shuffles_no_column_of_values(spark):
    """500 values of an identifier are few if they come often, 501 are many; those of other columns aren't counted."""
    n = 2000
    df = spark.range(n, numPartitions=3).select(F.col("id").alias("user_id"), (F.col("id") % 500).alias("team_id"), (F.col("id") % 501).alias("shop_id"), F.when(F.col("id") < 7, F.col("id")).alias("rare_id"), (F.col("id") % 2).alias("y"), F.rand(3).alias("fine"))
    found = {r["column"] for r in ml.leakage(df, "y").where("risk = 'UNIQUE_IDENTIFIER'").collect()}
    assert found == {"user_id", "shop_id", "rare_id"}
    plan = ml.leakage(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan.lower()


def test_targets_rank_churn_first(spark):
    df = spark.createDataFrame([(f"c{i}", 20 + i % 50, 10.5 * i, i % 2) for i in range(100)], "customer_id string, age int, monthly_spend double, churn int")
    assert ml.targets(df).orderBy(F.desc("confidence")).first()["column"] == "churn"


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(200).withColumn("y", F.col("id") % 4)
    a, b = ml.split(df, "id", "y"), ml.split(df.repartition(3), "id", "y")
    assert rows(a, "id") == rows(b, "id")
    assert {r["count"] for r in a.where("part = 'test'").groupBy("y").count().collect()} == {10}


def test_class_models_learn(spark):
    df = spark.range(300).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 > 4, "b").otherwise("a").alias("kind"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    parts = ml.split(df, "id", "label")
    board, models = ml.leaderboard(parts.where("part = 'train'"), parts.where("part = 'test'"), ml.preprocessor(["x"], ["kind"]), ["logistic", "decision_tree"], True)
    assert board.where("is_best").first()["f1"] == 1.0
    scored = ml.predict_batch(models["logistic"], df, "id", ["low", "high"]).where("id = 9").first()
    assert scored["predicted_label"] == "high" and scored["probabilities"]["high"] > 0.5


def test_dbscan(spark):
    df = spark.createDataFrame([(i, 0.1 * i, 0.0) for i in range(10)] + [(100 + i, 50 + 0.1 * i, 0.0) for i in range(10)] + [(999, 20.0, 20.0)], "id long, a double, b double")
    found = {r["id"]: r["cluster"] for r in ml.dbscan(df, "id", ["a", "b"]).collect()}
    assert found["999"] == "-1" and len(set(found.values())) == 3


def test_markdown_and_chunks(spark):
    docs = spark.createDataFrame([(1, "# Title\nSome text here.\n## Next\nMore text. " + "A sentence to repeat. " * 60), (2, None), (3, "")], "doc_id long, text string")
    found = rows(text.markdown_sections(docs, "doc_id", "text").select("doc_id", "position", "title"), "position")
    assert found == [(1, 1, "Title"), (1, 2, "Next")]
    out = text.chunks(text.text_sections(docs.select("doc_id", "text"), "doc_id", "text"), "doc_id", 100, 20)
    assert [r["chunk_id"] for r in out.where("doc_id = 1").orderBy("chunk_index").collect()] == ["1_chk_0", "1_chk_1", "1_chk_2", "1_chk_3"][: out.where("doc_id = 1").count()]
    assert out.agg(F.max("token_count")).first()[0] <= 100


def test_pack_keeps_long_sentences_whole():
    long = " ".join(["w"] * 30)
    assert text.pack(["a b c", long, "d e"], 10, 4) == ["a b c", long, "w w w w d e"]


def test_html(spark):
    assert text.html_text("<p>One &amp; two</p><script>no()</script><div>three</div>") == "One & two \n\nthree"


def test_bm25_and_hybrid(spark):
    chunks = spark.createDataFrame([("c1", "Customer retention improves with promotional offers", "s"), ("c2", "Server logs and disk usage", "s")], "chunk_id string, text string, section string")
    queries = spark.createDataFrame([(1, "retention promotional")], "query_id int, query string")
    assert retrieval.bm25_search(queries, chunks).first()["chunk_id"] == "c1"
    assert retrieval.hybrid_search(queries, chunks).orderBy("rank").first()["chunk_id"] == "c1"
    assert retrieval.retrieve_evidence(queries, chunks).orderBy("rank").first()["chunk_id"] == "c1"


def test_embedding_is_unit_or_zero(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id long, text string")
    for r in text.embed(docs, "doc_id", "text").collect():
        size = math.sqrt(sum(x * x for x in r["vector"]))
        assert len(r["vector"]) == 128 and size == pytest.approx(1.0 if r["doc_id"] == 1 else 0.0, abs=1e-4)


def _graph(spark):
    nodes = spark.createDataFrame([("n1", "Sales", "DATASET", "p", {"a": "b"}), ("n2", "Region", "COLUMN", "p", {}), ("n3", "Churn model", "MODEL", "p", {})], "id string, name string, node_type string, project_id string, properties map<string,string>")
    edges = spark.createDataFrame([("e1", "n1", "n2", "HAS_COLUMN", 1.0, {}, "p"), ("e2", "n3", "n1", "TRAINED_ON", 1.0, {}, "p")], "id string, source_id string, target_id string, relation string, weight double, properties map<string,string>, project_id string")
    return nodes, edges


def test_graph(spark):
    nodes, edges = _graph(spark)
    seeds = spark.createDataFrame([("n1",)], "seed string")
    assert graph.k_hop(edges, seeds, 1).count() == 3
    assert graph.metrics(nodes, edges).first()["is_connected"]
    assert rows(graph.paths(edges, spark.createDataFrame([("n3", "n2")], "source string, target string")).select("path", "score")) == [(["n3", "n1", "n2"], 0.3333)]
    told = {r["fact"] for r in graph.facts(edges, nodes).collect()}
    assert told == {"Dataset 'Sales' includes feature 'Region'.", "Model 'Churn model' was trained on dataset 'Sales'."}
    ranks = graph.pagerank(nodes, edges)
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    asked = spark.createDataFrame([(1, "churn model"), (2, "nothing")], "query_id int, query string")
    assert {r["query_id"] for r in graph.question(nodes, edges, asked).collect()} == {1}
    kept, left = graph.clear(nodes, edges, "p")
    assert kept.count() == left.count() == 0


def test_mentions_of_several_words(spark):
    nodes = spark.createDataFrame([("a", "Churn model"), ("b", "no"), ("c", "one two three four five six")], "id string, name string")
    docs = spark.createDataFrame([(1, "The churn-model is fine."), (2, "churn modelling"), (3, None), (4, "One two three four five six!")], "doc_id long, text string")
    assert rows(graph.mentions(docs, nodes, "doc_id", "text"), "doc_id") == [(1, "a"), (4, "c")]


def test_stream_rule():
    values = [50 + 5 * i / 39 for i in range(40)] + [80.0]
    found, held = streaming.scan_values(values, [], 30, 2.5, 2.5)
    assert [i for i, _, _ in found] == [40] and len(held) == 30
    flat, _ = streaming.scan_values([10.0] * 25 + [500.0], [], 30, 2.5, 2.5)
    assert [i for i, _, _ in flat] == [25]


def test_stream_over_several_batches_equals_batch(spark, tmp_path):
    df = spark.range(120).select(F.col("id").alias("event_id"), F.lit("s").alias("series"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") * 37 % 11 + F.when(F.col("id").isin(40, 77, 111), 200).otherwise(0)).cast("double").alias("v"))
    for k in range(3):
        df.where(f"event_id div 40 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = rows(streaming.batch_anomalies(streaming.records(df, "series", "ts", "event_id", ["v"])).select("event_id", "anomaly_type"), "event_id")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = streaming.parquet_stream(spark, df.schema, str(tmp_path / "in"), 3)
    from tarnwick.sources import sinks

    sinks.write_alerts(streaming.stream_anomalies(streaming.records(stream, "series", "ts", "event_id", ["v"])), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert rows(spark.read.schema(streaming.OUTPUT).parquet(str(tmp_path / "out")).select("event_id", "anomaly_type"), "event_id") == want and want



def test_stream_query_counts_every_row(spark, tmp_path):
    import __spark_entry__ as entry

    from conftest import SF, compare

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionAll(events).coalesce(1).write.parquet(str(tmp_path / "twice"))
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    part = next((tmp_path / "twice").glob("part-*.parquet"))
    (tmp_path / "events.parquet").symlink_to(part)
    compare(entry.queries()["stream_severity"](spark, str(tmp_path)), entry.oracle_sql()["stream_severity"], str(tmp_path))


def test_stream_rule_at_the_threshold():
    """A distance of exactly the threshold counts, whatever the sum of equal values loses."""
    for v in (3.41, 29.27, 91.62, 151.03):
        for sign in (-1, 1):
            found, _ = streaming.scan_values([v] * 50 + [round(v + sign * 2.8, 2)], [], 50, 2.8, 2.5)
            assert [k for _, _, k in found] == ["combined"]

def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name;age\nAnn;30\nBob;25\nCle;41\n")
    assert rows(readers.read_auto(spark, str(tmp_path / "a.csv")), "name") == [("Ann", 30), ("Bob", 25), ("Cle", 41)]
    (tmp_path / "b.json").write_text('[{"id": 1, "val": {"x": "a"}}, {"id": 2, "val": {"x": "b"}}]')
    assert rows(readers.read_auto(spark, str(tmp_path / "b.json")).select("id", F.col("`val.x`")), "id") == [(1, "a"), (2, "b")]
    (tmp_path / "c.json").write_text('{"meta": 1, "rows": [{"id": 5}], "more": [{"k": 1}]}')
    assert rows(readers.read_json(spark, str(tmp_path / "c.json"))) == [(5,)]
    with pytest.raises(ValueError):
        readers.read_auto(spark, "x.txt")
    assert readers.sniff("é;b\n1;2".encode("latin-1")) == ("latin-1", ";")


def test_validate_counts_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\nx,3\n")
    assert rows(readers.validate(spark, str(tmp_path / "a.csv"), "id long, v long").select("rows_read", "corrupt", "is_valid")) == [(2, 1, False)]


def test_gaps_and_imputation(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, 5.0), ("s", 3, None), ("t", 1, None)], "k string, i int, v double")
    assert rows(cleaning.fill_order_gaps(df, "v", ["k"], ["i"]), "k", "i") == [("s", 1, 5.0), ("s", 2, 5.0), ("s", 3, 5.0), ("t", 1, 0.0)]
    assert [r["v"] for r in cleaning.impute(df, ["v"]).orderBy("k", "i").collect()] == [5.0] * 4


def test_nan_is_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "i int, v double")
    assert rows(C.normalize_nulls(df), "i") == [(1, None), (2, 1.0)]


def test_verdicts(spark):
    claims = spark.createDataFrame([("b", "1", "accuracy", 0.90), ("b", "2", "ACC", 0.5), ("b", "3", "other", 1.0)], "batch string, claim_id string, name string, claimed double")
    metrics = spark.createDataFrame([("accuracy", 0.91)], "metric string, value double")
    found = {r["claim_id"]: r["status"] for r in explore.audit_claims(explore.match_claims(claims, metrics)).collect()}
    assert found == {"1": "SUPPORTED", "2": "REJECTED", "3": "REJECTED"}


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np
    from tarnwick.functions.ranges import exact_quantiles

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=30_000), "b": rng.integers(0, 4, 5000).astype(float), "c": np.array([3.0]), "d": np.array([1.0, 2.0, 10.0]), "e": np.repeat(7.0, 400), "f": np.concatenate([np.zeros(20_000), [5.0, 6.0]])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", at).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12, abs=1e-12)
    whole = exact_quantiles(df, [], "v", [0.5]).first()["q"]
    assert whole == pytest.approx([float(np.median(np.concatenate(list(groups.values()))))])
    assert exact_quantiles(df.limit(0), ["k"], "v", at).count() == 0


def test_correlations_of_gaps_and_constants(spark):
    from tarnwick.operators import explore

    rows = [(float(i), float(-2 * i + 1e9), 5.0, float(i * i) if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double, flat double, z double")
    got = {(r["column_a"], r["column_b"]): r["r"] for r in explore.correlations(df, df.columns).collect()}
    pairs = [(float(i), float(i * i)) for i in range(50) if i % 3]
    import numpy as np

    want = round(float(np.corrcoef(*zip(*pairs))[0, 1]), 3)
    assert got["x", "y"] == -1.0 and got["x", "z"] == want and got["x", "flat"] == got["flat", "z"] == 0.0 and len(got) == 6


def test_nearest_points_over_many_tiles(spark, monkeypatch):
    """Many tiles, a dense point that a third of the rows share, far points, ties by number: as by brute force."""
    import numpy as np
    from tarnwick.operators import anomaly

    monkeypatch.setattr(anomaly, "TILE", 16)
    monkeypatch.setattr(anomaly, "STRIP", 4)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 2)), 1)
    x[:200] = x[0]
    x[590:] = rng.normal(0, 60, size=(10, 2))
    ids = rng.permutation(10_000)[:600]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "i long, x array<double>")
    got = {}
    for r in anomaly.nearest(df, 2, 7).collect():
        got.setdefault(r["i"], set()).add((r["j"], r["d"]))
    for n, i in enumerate(ids):
        d = np.round(np.sqrt(((x - x[n]) ** 2).sum(1)), 9)
        want = sorted((d[m], ids[m]) for m in range(600) if m != n)[:7]
        assert got[i] == {(int(j), float(w)) for w, j in want}
    few = anomaly.local_outlier_factor(spark.createDataFrame([(1, 1.0, None), (2, 1.1, 2.0), (3, 9.0, 2.0)], "id long, a double, b double"), "id", ["a", "b"], 2)
    assert few.count() == 3


def test_arima_follows_an_autoregression(spark):
    """One step ahead of an AR(1) series lies near what its coefficient says, and the forecasts go on to the mean's side."""
    import numpy as np

    rng = np.random.default_rng(2)
    y = [0.0]
    for _ in range(400):
        y.append(0.8 * y[-1] + rng.normal(0, 0.1))
    y = [v + 20 for v in y]
    out = rows(forecast.solved(series(spark, y), ["series"], "day", "y", 5, "arima").select("step", "forecast"), "step")
    assert abs(out[0][1] - (20 + 0.8 * (y[-1] - 20))) < 0.15 and all(abs(v - 20) < 2 for _, v in out)


def test_sarima_knows_the_season(spark):
    values = [100 + 20 * (i % 7 == 5) + 0.1 * i for i in range(84)]
    out = rows(forecast.solved(series(spark, values[:77]), ["series"], "day", "y", 7, "sarima").select("step", "forecast"), "step")
    assert max(out, key=lambda x: x[1])[0] == [i % 7 for i in range(77, 84)].index(5) + 1


def test_direct_forecast_goes_on_along_a_line(spark):
    values = [5 + 2.0 * i for i in range(60)]
    out = rows(forecast.direct_forecast(series(spark, values), ["series"], "day", "y", 4).select("step", "forecast"), "step")
    assert [v for _, v in out] == pytest.approx([5 + 2.0 * i for i in range(60, 64)], abs=0.5)


def test_tuning_takes_the_best_draw_and_folds_are_averaged(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tarnwick.operators import ml

    df = spark.createDataFrame([(i, float(i % 13), float(i % 7), 3.0 * (i % 13) - (i % 7) + 1) for i in range(300)], "id int, a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model, table = ml.tune(df, LinearRegression(solver="normal"), {"regParam": [0.0, 1.0, 10.0, 100.0]}, RegressionEvaluator(metricName="rmse"), trials=15)
    assert table.orderBy("score").first()["params"] == {"regParam": "0.0"} and model.coefficients.toArray().tolist() == pytest.approx([3.0, -1.0], abs=1e-6)
    folded = ml.folds(df, "id", 3)
    got = {r["metric"]: r["mean"] for r in ml.cross_validate(folded, LinearRegression(regParam=1.0, solver="normal"), False, 3).collect()}
    errors = []
    for k in range(3):
        fitted = LinearRegression(regParam=1.0, solver="normal").fit(folded.where(f"fold <> {k}"))
        errors.append(RegressionEvaluator(metricName="rmse").evaluate(fitted.transform(folded.where(f"fold = {k}"))))
    assert got["rmse"] == pytest.approx(sum(errors) / 3, abs=1e-4)


def test_chunks_like_brute_force(spark):
    """Chunks of the given documents: whole sentences in order, as long as they fit, with the last words of a full chunk before the next."""
    import re

    from tarnwick.operators import text

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {}
    for r in text.chunks(text.text_sections(docs, "doc_id", "text"), "doc_id", 60, 10).orderBy("chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for r in docs.collect():
        want = []
        for part in re.split(r"\n+", r["text"] or ""):
            want += [s.split() for s in re.split(r"(?<=[.?!])\s+", part.strip()) if s]
        chunks, now = [], []
        for words in want:
            if now and len(now) + len(words) > 60:
                chunks.append(now)
                now = now[len(now) - 10 :] if len(now) > 10 else []
            now = now + words
        chunks += [now] if now else []
        assert [c.split() for c in got.get(r["doc_id"], [])] == chunks


def test_folder_of_mixed_dialects(spark, tmp_path):
    """Four files of three encodings, three delimiters and two orders of columns are one table."""
    texts = {"a.csv": ("id,name,n\n1,Zoë,5\n2,Łukasz,6\n", "utf-8"), "b.csv": ("name;id;n\nprice €5;3;7\n", "cp1252"), "c.csv": ("id\tname\tn\n4\tfrançais\t8\n5\tx\tmany\n", "latin-1"), "d [1].csv": ("\nid,name,n,more\n6,plain,9,z\n", "utf-8-sig")}
    for name, (body, encoding) in texts.items():
        (tmp_path / name).write_bytes(body.encode(encoding))
    (tmp_path / "e.csv").write_bytes(b"")
    found = readers.dialects(spark, str(tmp_path))
    assert sorted((x.encoding, x.delimiter) for x in found) == [("ISO-8859-1", "\t"), ("UTF-8", ","), ("UTF-8", ","), ("windows-1252", ";")]
    got = {int(r["id"]): (r["name"], r["n"], r["more"]) for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert got == {1: ("Zoë", "5", None), 2: ("Łukasz", "6", None), 3: ("price €5", "7", None), 4: ("français", "8", None), 5: ("x", "many", None), 6: ("plain", "9", "z")}
    typed = readers.read_csv(spark, str(tmp_path), schema="name string, id int")
    assert typed.columns == ["name", "id"] and {(r["id"], r["name"]) for r in typed.collect()} == {(k, v[0]) for k, v in got.items()}
    about = readers.file_metadata(spark, str(tmp_path), "csv").first()
    assert about["columns"] == ["id", "name", "n", "more"] and about["row_count"] == 6 and about["files"] == 4
    assert about["delimiters"] == ["\t", ",", ";"] and about["encodings"] == ["ISO-8859-1", "UTF-8", "windows-1252"]
    judged = {r["file"]: (r["rows_read"], r["corrupt"]) for r in readers.validate(spark, str(tmp_path), "id int, name string, n int").collect()}
    assert judged["a.csv"] == (2, 0) and judged["b.csv"] == (1, 0) and judged["c.csv"] == (2, 1)


def test_json_takes_the_first_list_of_the_whole_file(spark, tmp_path):
    """The first list of records is the table, though its key stands far behind the head of the file."""
    import json

    body = {"note": "x" * 20000, "rows": [{"v": 1}, {"v": 2}], "also": [{"w": 3}]}
    (tmp_path / "one.json").write_text(json.dumps(body))
    assert [r["v"] for r in readers.read_json(spark, str(tmp_path / "one.json")).collect()] == [1, 2]


def _clusters_by_pairs(points, eps, least):
    """Density clusters by all pairs: key -> least core key of its cluster, or -1."""
    near = {i: [j for j, q in points.items() if sum((a - b) * (a - b) for a, b in zip(p, q)) <= eps * eps] for i, p in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += [k for k in near[j] if k in core and k not in label]
    return {i: label[i] if i in core else label[min((j for j in near[i] if j in core), default=i)] if any(j in core for j in near[i]) else "-1" for i in points}


@pytest.mark.parametrize("width,few", [(1, 4096), (2, 4096), (2, 4), (3, 4)])
def test_dbscan_like_all_pairs(spark, monkeypatch, width, few):
    """Clusters by cells equal those by all pairs, also where boxes are halved many times; copies, gaps and odd values included."""
    import random

    from tarnwick.operators import density

    monkeypatch.setattr(density, "FEW", few)
    draw = random.Random(width * 10 + few)
    points = {f"k{n}": tuple(draw.gauss(c, 0.35) for _ in range(width)) for n, c in enumerate([draw.choice([0, 1.5, 4]) for _ in range(140)])}
    points |= {f"u{n}": tuple(draw.uniform(-3, 8) for _ in range(width)) for n in range(40)}
    points |= {f"c{n}": tuple([1.0] * width) for n in range(60)}  # copies: a quarter of all rows in one cell
    names = [f"x{d}" for d in range(width)]
    data = [(k, *v) for k, v in points.items()] + [("null", *[None] * width), ("nan", *[math.nan] * width), ("far", *[math.inf] * width)]
    df = spark.createDataFrame(data, "id string, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["cluster"] for r in ml.dbscan(df, "id", names, 0.3, 5).collect()}
    assert got == _clusters_by_pairs(points, 0.3, 5) | {"null": "-1", "nan": "-1", "far": "-1"}
    assert ml.dbscan(df.limit(0), "id", names).count() == 0


def test_dense_cells_give_no_pairs(spark):
    """20,000 points in two cells just apart: far fewer pairs are compared than they have."""
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"), (F.rand(1) * 0.1 + F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.65)).alias("a"), (F.rand(2) * 0.1).alias("b"))
    assert {(r["cluster"], r["count"]) for r in ml.dbscan(df, "id", ["a", "b"], 0.5, 5).groupBy("cluster").count().collect()} == {("0", 10000), ("1", 10000)}


def test_folds_are_even(spark):
    """Folds of each class differ by one row at most, keep all columns and rows, and don't depend on partitions."""
    df = spark.range(1003).select("id", F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("kind"))
    cut = ml.folds(df, "id", 4, "kind")
    sizes = {}
    for r in cut.groupBy("kind", "fold").count().collect():
        sizes.setdefault(r["kind"], []).append(r["count"])
    assert cut.columns == ["id", "kind", "fold"] and all(len(s) == 4 and max(s) - min(s) <= 1 for s in sizes.values()) and sum(map(sum, sizes.values())) == 1003
    assert rows(cut, "id") == rows(ml.folds(df.repartition(7), "id", 4, "kind"), "id")


def test_paths_like_every_walk(spark):
    """The best paths of many pairs equal those of all walks, in a random graph with loops and parallel edges."""
    import random

    draw = random.Random(5)
    links = {(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}") for _ in range(60)}
    asked = [(f"n{a}", f"n{b}") for a in range(0, 14, 2) for b in range(1, 14, 3)] + [("n0", "n0"), ("n1", "none"), ("n1", None)]
    want = {}
    for source, target in asked:
        walks, ends = [[source]], []
        for _ in range(3):
            walks = [w + [b] for w in walks for a, b in links if a == w[-1] and b not in w and w[-1] != target]
            ends += [w for w in walks if w[-1] == target]
        want |= {(source, target, n): p for n, p in enumerate(sorted(ends, key=lambda p: (len(p), p))[:4], 1)}
    df = spark.createDataFrame([*links, ("n3", None), *list(links)[:5]], "source_id string, target_id string")
    found = graph.paths(df, spark.createDataFrame(asked, "source string, target string"), 3, 4)
    assert {(r["source"], r["target"], r["rank"]): r["path"] for r in found.collect()} == want


def test_paths_past_a_hub(spark):
    """Of a hub's 100,000 edges only those on the way to a target are walked."""
    out = spark.range(100000).select(F.lit("hub").alias("source_id"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("target_id"))
    more = spark.createDataFrame([("s", "hub"), ("leaf7", "t"), ("leaf8", "u"), ("u", "t")], "source_id string, target_id string")
    found = graph.paths(out.union(more), spark.createDataFrame([("s", "t"), ("hub", "t"), ("t", "s")], "source string, target string"))
    assert rows(found.select("source", "path", "rank"), "source", "rank") == [("hub", ["hub", "leaf7", "t"], 1), ("hub", ["hub", "leaf8", "u", "t"], 2), ("s", ["s", "hub", "leaf7", "t"], 1)]


def test_workbooks_are_read_row_by_row(spark):
    """A workbook of 50,000 rows takes no more memory than some of them and its file."""
    import io
    import tracemalloc
    import zipfile

    from tarnwick.sources import readers

    def book(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c t="inlineStr"><is><t>a</t></is></c></row>{"".join(f"<row><c><v>{i}</v></c></row>" for i in range(n))}</sheetData></worksheet>')
        return out.getvalue()

    content = book(50_000)
    tracemalloc.start()
    assert sum(1 for _ in readers._sheet_rows(content, None)) == 50_001
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()
    got = readers.parse_workbooks(spark.createDataFrame([("p", book(2500)), ("q", book(0))], "path string, content binary")).collect()
    assert sorted((r["path"], r["row"], r["cells"]["a"]) for r in got) == [("p", i, str(i)) for i in range(2500)]


def test_pages_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def look(x):
        seen.add(1)
        return x

    html = ["<p>one</p><p>two</p>", "", None, "<p> </p>", "<div>a</div><div></div><div>b</div>", "<p>&#9;&nbsp;x</p>"] * 30
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = text.html_sections(pages.withColumn("html", look.asNondeterministic()("html")), "page_id", "html").collect()
    assert seen.value == len(html)
    plain = spark.createDataFrame([(i, text.html_text(h)) for i, h in enumerate(html)], "page_id long, text string")
    assert sorted(map(tuple, got)) == sorted(map(tuple, text.text_sections(plain, "page_id", "text").collect()))


def test_detectors_score_rows_once(spark):
    """The forest's scores are read back, not computed again; errors of the projection are plain columns and those of numpy."""
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + 5
    df = spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(data)], "id int, a double, b double, c double, flat double")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan(anomaly.isolation_forest(df, "id", ["a", "b"], trees=3))
    out = anomaly.reconstruction(df, ["a", "b", "c", "flat"])
    assert "UDF(" not in plan(out) and out.columns == [*df.columns, "reconstruction_score", "reconstruction_flag"]
    u = np.c_[(data - data.mean(0)) / data.std(0, ddof=1), np.zeros(60)]
    basis = np.linalg.svd(u - u.mean(0))[2][:2].T
    error = ((u - u @ basis @ basis.T) ** 2).mean(1)
    got = np.array([r[0] for r in out.orderBy("id").select("reconstruction_score").collect()])
    assert np.allclose(got, error / error.max(), atol=1e-4)


@pytest.mark.parametrize("name", ["alert_sink", "stream_anomaly", "stream_severity", "stream_stats"])
def test_stream_queries_need_no_times_of_change(spark, monkeypatch, name):
    """Files that carry times in the wrong order, as where a file system lets none be set, are still taken in the order of the events."""
    import __spark_entry__ as entry

    from conftest import SF, compare
    from tarnwick.functions import folders

    def reversed_order(spark, path):
        files, at = folders._at(spark, path)
        found = sorted((x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
        for i, x in enumerate(found):
            files.setTimes(x, 1_700_000_000_000 - 1000 * i, -1)

    monkeypatch.setattr(folders, "in_order", reversed_order)
    compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF)


def test_stream_goes_by_time_where_an_hour_comes_twice(spark, tmp_path):
    """The hour before and after summer time ends has the same local times; both forms go by the instants."""
    from tarnwick.sources import sinks

    zone, provider = spark.conf.get("spark.sql.session.timeZone"), "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        value = F.when(F.col("id").isin(30, 90, 110), 40.0).otherwise(F.when(F.col("id") < 60, 10.0).otherwise(30.0)) + F.col("id") * 37 % 5 / 10
        df = spark.range(120).select(F.col("id").alias("event_id"), F.lit("s").alias("series"), F.timestamp_seconds(F.lit(1729987200) + F.col("id") * 60).alias("ts"), value.cast("double").alias("v"))
        df.coalesce(1).write.parquet(str(tmp_path / "in"))
        want = rows(streaming.batch_anomalies(streaming.records(df, "series", "ts", "event_id", ["v"])).select("event_id", "anomaly_type", F.unix_micros("ts").alias("us")), "event_id")
        stream = streaming.parquet_stream(spark, df.schema, str(tmp_path / "in"))
        sinks.write_alerts(streaming.stream_anomalies(streaming.records(stream, "series", "ts", "event_id", ["v"]), late=None), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = spark.read.schema(streaming.OUTPUT).parquet(str(tmp_path / "out"))
        assert rows(got.select("event_id", "anomaly_type", F.unix_micros("ts").alias("us")), "event_id") == want and want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.unset(provider)


def test_stream_rule_on_large_values():
    """Equal values have no deviation, however large they are: the distance is then measured by 1."""
    found, _ = streaming.scan_values([1e9 + 0.01] * 60 + [1e9 + 1.01], [], 50, 2.8, 2.5)
    assert found == []
    found, _ = streaming.scan_values([1e9 + 0.01] * 60 + [1e9 + 4.01], [], 50, 2.8, 2.5)
    assert found == [(60, 4.0, "combined")]
