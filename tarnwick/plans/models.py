"""Queries: drift, the model registry and machine learning."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..operators import drift, ml, profile, registry
from .base import MESSY, Section, derived, scratch, table
from .profiling import _SCHEMA

S = Section()
query = S.query

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_HALF = "TIMESTAMP '1998-06-01 00:00:00'"
# the later half has its quantities shifted, so that one column drifts
_REF = f"SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate < {_HALF}"
_CUR = f"SELECT l_quantity + 8 AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate >= {_HALF}"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    return derived(spark, d, _REF), derived(spark, d, _CUR)


def _psi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(abs(sum((q - p) * ln(q / p))), 4) AS psi FROM (
 SELECT i, greatest((SELECT count(*) FROM ref WHERE {c} >= e[1] AND {c} <= e[len(e)] AND least(len(list_filter(e, lambda x: x <= {c})), len(e) - 1) = i) / (SELECT count(*) FROM ref), 1e-8) AS p,
  greatest((SELECT count(*) FROM cur WHERE {c} >= e[1] AND {c} <= e[len(e)] AND least(len(list_filter(e, lambda x: x <= {c})), len(e) - 1) = i) / (SELECT count(*) FROM cur), 1e-8) AS q
 FROM (SELECT e, unnest(range(1, len(e))) AS i FROM (SELECT list_sort(list_distinct(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM ref)))"""


def _ks_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", max(abs(x / n - y / m)) AS dd, max(n) AS n, max(m) AS m FROM (SELECT v, sum(a) OVER (ORDER BY v) AS x, sum(b) OVER (ORDER BY v) AS y, (SELECT count(*) FROM ref) AS n, (SELECT count(*) FROM cur) AS m
 FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM ref UNION ALL SELECT {c}, 0, 1 FROM cur) GROUP BY v))"""


_P = "(sqrt(n * m / (n + m)) + 0.12 + 0.11 / sqrt(n * m / (n + m))) * dd"
_DRIFT = f"""ref AS ({_REF}), cur AS ({_CUR}), psi AS ({' UNION ALL '.join(map(_psi_sql, _COLS))}), ks0 AS ({' UNION ALL '.join(map(_ks_sql, _COLS))}),
ks AS (SELECT "column", round(dd, 6) AS ks, round(CASE WHEN {_P} < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 51), lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * ({_P}) * ({_P})))))) END, 6) AS p_value FROM ks0)"""
_REPORT = f"""WITH {_DRIFT}, s AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS "column", (SELECT avg({c}) FROM ref) AS a, (SELECT avg({c}) FROM cur) AS b, (SELECT stddev_pop({c}) FROM ref) AS sa, (SELECT stddev_pop({c}) FROM cur) AS sb' for c in _COLS)}),
report AS (SELECT "column", round(a, 4) AS mean_ref, round(b, 4) AS mean_cur, round(sa, 4) AS std_ref, round(sb, 4) AS std_cur, round(100 * (b - a) / (abs(a) + 1e-8), 2) AS shift_pct, psi, ks, p_value,
 CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'minor' WHEN psi < 0.3 THEN 'moderate' ELSE 'major' END AS level, psi >= 0.2 OR p_value <= 0.05 AS alert FROM s JOIN psi USING ("column") JOIN ks USING ("column"))"""


@query("drift_psi", f"WITH {_DRIFT} SELECT * FROM psi")
def _(spark, d):
    return drift.psi(*_sides(spark, d), _COLS)


@query("drift_ks", f"WITH {_DRIFT} SELECT * FROM ks")
def _(spark, d):
    return drift.ks(*_sides(spark, d), _COLS)


@query("drift_report", f"{_REPORT} SELECT * FROM report")
def _(spark, d):
    return drift.report(*_sides(spark, d))


@query("drift_overall", f"""{_REPORT}, o AS (SELECT round(avg(psi), 4) AS mean_psi, coalesce(string_agg("column", ',' ORDER BY "column") FILTER (alert), '') AS drifted, coalesce(string_agg("column", ',' ORDER BY "column") FILTER (NOT alert), '') AS stable, bool_or(alert) AS alert FROM report)
SELECT *, CASE WHEN mean_psi < 0.1 THEN 'none' WHEN mean_psi < 0.2 THEN 'minor' WHEN mean_psi < 0.3 THEN 'moderate' ELSE 'major' END AS level FROM o""")
def _(spark, d):
    return drift.overall(drift.report(*_sides(spark, d)))


# a registry of one model for each order status and one version for each priority; figures from the orders
_EVENTS = "SELECT o_orderstatus AS model_id, concat(o_orderstatus, '-', substr(o_orderpriority, 1, 1)) AS version_id, substr(o_orderpriority, 1, 1) AS created_at, concat('Model ', o_orderstatus) AS name, 'gbt' AS algorithm, round(avg(o_totalprice) / 500000, 4) AS accuracy, round(stddev_pop(o_totalprice) / 500000, 4) AS rmse FROM orders GROUP BY o_orderstatus, o_orderpriority"
_REG = f"ev AS ({_EVENTS}), reg AS (SELECT *, concat('v', row_number() OVER (PARTITION BY model_id ORDER BY created_at, version_id)) AS version_tag, lag(version_id) OVER (PARTITION BY model_id ORDER BY created_at, version_id) AS parent_id FROM ev)"


def versions(spark, d) -> DataFrame:
    rows = derived(spark, d, _EVENTS).withColumn("metrics", F.create_map(F.lit("accuracy"), "accuracy", F.lit("rmse"), "rmse"))
    return registry.register(rows)


@query("registry_register", f"WITH {_REG} SELECT model_id, version_id, version_tag, parent_id FROM reg")
def _(spark, d):
    return versions(spark, d).select("model_id", "version_id", "version_tag", "parent_id")


@query("registry_list", f"WITH {_REG} SELECT version_id, version_tag, accuracy FROM reg WHERE model_id = 'F'")
def _(spark, d):
    return registry.versions(versions(spark, d), "F").select("version_id", "version_tag", "accuracy")


_COMPARE = f"""WITH {_REG}, mm AS (SELECT version_id, 'accuracy' AS metric, accuracy AS value FROM reg UNION ALL SELECT version_id, 'rmse', rmse FROM reg), pr AS (SELECT parent_id AS a, version_id AS b FROM reg WHERE parent_id IS NOT NULL),
c AS (SELECT pr.a, pr.b, x.metric, x.value AS value_a, y.value AS value_b, round(y.value - x.value, 6) AS delta FROM pr JOIN mm x ON x.version_id = pr.a JOIN mm y ON y.version_id = pr.b AND y.metric = x.metric),
compared AS (SELECT *, CASE WHEN delta = 0 THEN 'tie' WHEN (metric = 'rmse' AND delta < 0) OR (metric <> 'rmse' AND delta > 0) THEN 'b' ELSE 'a' END AS winner FROM c)"""


def _compared(spark, d):
    rows = versions(spark, d)
    return registry.compare(rows, rows.where("parent_id is not null").select(F.col("parent_id").alias("a"), F.col("version_id").alias("b")))


@query("metric_compare_join", f"{_COMPARE} SELECT a, b, metric, value_a, value_b FROM compared")
def _(spark, d):
    return _compared(spark, d).select("a", "b", "metric", "value_a", "value_b")


@query("registry_compare", f"{_COMPARE} SELECT * FROM compared")
def _(spark, d):
    return _compared(spark, d)


@query("registry_winners", f"{_COMPARE}, w AS (SELECT a, b, count(*) FILTER (winner = 'a') AS wins_a, count(*) FILTER (winner = 'b') AS wins_b FROM compared GROUP BY 1, 2) SELECT *, CASE WHEN wins_b > wins_a THEN 'b' WHEN wins_a > wins_b THEN 'a' ELSE 'tie' END AS winner FROM w")
def _(spark, d):
    return registry.winners(_compared(spark, d))


@query("registry_promote", f"WITH {_REG} SELECT version_id, CASE WHEN accuracy >= 0.5 THEN 'production' WHEN created_at <= '2' THEN 'staging' ELSE 'development' END AS stage FROM reg")
def _(spark, d):
    rows = versions(spark, d)
    early = rows.where("created_at <= '2'").select("version_id", F.lit("staging").alias("stage"), F.lit(1).alias("at"))
    good = rows.where("accuracy >= 0.5").select("version_id", F.lit("production").alias("stage"), F.lit(2).alias("at"))
    wrong = rows.select("version_id", F.lit("nowhere").alias("stage"), F.lit(3).alias("at"))
    return registry.promote(rows, early.union(good).union(wrong)).select("version_id", "stage")


@query("registry_lineage", f"WITH RECURSIVE {_REG}, l AS (SELECT version_id, 0 AS depth, version_id AS ancestor FROM reg UNION ALL SELECT l.version_id, depth + 1, reg.parent_id FROM l JOIN reg ON reg.version_id = l.ancestor WHERE reg.parent_id IS NOT NULL) SELECT version_id, CAST(depth AS INTEGER) AS depth, ancestor FROM l")
def _(spark, d):
    return registry.lineage(versions(spark, d))


# tables to learn from

_LEARN = "SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, d.lang, d.source, CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS spaces, CAST(length(d.text) - length(replace(d.text, '.', '')) AS DOUBLE) AS stops, CAST(length(d.text) - length(replace(d.text, '*', '')) AS DOUBLE) AS stars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_PRICE = "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS price_net FROM lineitem"


def learn(spark, d) -> DataFrame:
    return derived(spark, d, _LEARN)


@query("ml_targets", f"""WITH t AS ({MESSY}) SELECT 'status' AS "column", CAST(0.25 AS DOUBLE) AS confidence, 'binary_classification' AS suggested_type, count(DISTINCT status) AS unique_count, count(*) - count(status) AS null_count FROM t
UNION ALL SELECT 'price', 0.75, 'regression', count(DISTINCT price), count(*) - count(price) FROM t UNION ALL SELECT 'channel', 0.2, 'classification', count(DISTINCT channel), 0 FROM t UNION ALL SELECT 'priority', 0.2, 'multiclass_classification', count(DISTINCT priority), 0 FROM t
UNION ALL SELECT 'customer_age', 0.2, 'regression', count(DISTINCT customer_age), 0 FROM t UNION ALL SELECT 'placed', 0.2, 'classification', count(DISTINCT placed), 0 FROM t UNION ALL SELECT 'repeat_buyer', 0.4, 'binary_classification', count(DISTINCT repeat_buyer), 0 FROM t""")
def _(spark, d):
    return ml.targets(derived(spark, d, MESSY))


@query("ml_problem_type", f"WITH t AS ({_LEARN}), c AS (SELECT quality, count(*) AS n FROM t GROUP BY 1) SELECT 'binary_classification' AS problem_type, count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows, round(100 * min(n) / sum(n), 2) AS minority_pct, round(100 * min(n) / sum(n), 2) <= 25 AS imbalanced FROM c")
def _(spark, d):
    return ml.problem_type(learn(spark, d), "quality")


@query("ml_leakage", """SELECT 'price_net' AS "column", 'TARGET_DERIVED_FEATURE' AS risk, 'CRITICAL' AS severity UNION ALL SELECT 'row_id', 'UNIQUE_IDENTIFIER', 'HIGH' UNION ALL SELECT 'price_net', 'NEAR_PERFECT_CORRELATION', 'CRITICAL' FROM lineitem HAVING corr(l_extendedprice, l_extendedprice * (1 - l_discount)) >= 0.98""")
def _(spark, d):
    return ml.leakage(derived(spark, d, _PRICE), "price")


@query("ml_feature_types", f"""WITH {_SCHEMA} SELECT "column", CASE inferred_type WHEN 'NUMERICAL' THEN 'numerical' WHEN 'DATETIME' THEN 'datetime' WHEN 'CATEGORICAL' THEN 'categorical' WHEN 'BOOLEAN' THEN 'categorical' WHEN 'TEXT' THEN 'categorical' ELSE 'dropped' END AS role FROM schema_report WHERE "column" <> 'repeat_buyer'""")
def _(spark, d):
    return ml.feature_types(profile.detect_schema(derived(spark, d, MESSY)), "repeat_buyer")


@query("ml_datetime_features", "SELECT o_orderkey, CAST(coalesce(year(t), 2020) AS INTEGER) AS t_year, CAST(coalesce(month(t), 1) AS INTEGER) AS t_month, CAST(coalesce(day(t), 1) AS INTEGER) AS t_day, CAST(coalesce((dayofweek(t) + 6) % 7, 0) AS INTEGER) AS t_dayofweek FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS t FROM orders)")
def _(spark, d):
    return ml.datetime_features(derived(spark, d, "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS t FROM orders"), ["t"])


@query("ml_preprocess")
def _(spark, d):
    rows = ml.split(learn(spark, d), "doc_id", "quality")
    fitted = ml.preprocessor(["n_chars", "spaces", "stops", "stars"], ["lang"]).fit(rows.where("part = 'train'"))
    return fitted.transform(rows).select("doc_id", "part", F.expr("aggregate(transform(array(n_chars, spaces), x -> x), 0D, (a, b) -> a + b)").alias("raw_sum"), ml.vector_to_array("features").alias("features"))


_SPLIT = f"t AS ({_LEARN}), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM t), s AS (SELECT *, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r)"


@query("ml_split", f"WITH {_SPLIT} SELECT doc_id, quality, part FROM s")
def _(spark, d):
    return ml.split(learn(spark, d), "doc_id", "quality").select("doc_id", "quality", "part")


@query("ml_baseline", f"WITH {_SPLIT}, g AS (SELECT quality AS g FROM s WHERE part = 'train' GROUP BY 1 ORDER BY count(*) DESC, quality LIMIT 1) SELECT CAST(min(g) AS VARCHAR) AS prediction, 'accuracy' AS metric, round(avg(CAST(quality = g AS INTEGER)), 4) AS value FROM s, g WHERE part = 'test'")
def _(spark, d):
    return ml.baseline(ml.split(learn(spark, d), "doc_id", "quality"), "quality")


def _ready(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = ml.split(learn(spark, d).withColumn("label", F.col("quality").cast("double")), "doc_id", "quality")
    fitted = ml.preprocessor(["n_chars", "spaces", "stops", "stars"], ["lang"]).fit(rows.where("part = 'train'"))
    out = fitted.transform(rows)
    return out, out.where("part = 'train'"), out.where("part = 'test'")


@query("ml_classify")
def _(spark, d):
    _, train, test = _ready(spark, d)
    model = ml.classifier("logistic", weightCol="weight").fit(ml.balanced(train, "label"))
    return model.transform(test).select("doc_id", "label", "prediction", F.round(ml.vector_to_array("probability")[1], 6).alias("score"))


@query("ml_regress")
def _(spark, d):
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(derived(spark, d, _PRICE).withColumn("label", F.col("price")))
    return ml.regressor("ridge").fit(rows).transform(rows).select("row_id", "label", F.round("prediction", 4).alias("prediction"))


@query("ml_regress_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


def _vectors(spark, d) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("ml_cluster")
def _(spark, d):
    return ml.cluster(_vectors(spark, d), "kmeans", 5).select("vec_id", "cluster")


@query("ml_cluster_dbscan")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 5).alias("a"), (F.col("p_retailprice") / 10).alias("b"))
    return ml.dbscan(rows, "p_partkey", ["a", "b"], 0.5, 5)


_C = ["p_size", "p_retailprice"]


@query("ml_cluster_metrics", """WITH r AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS c, p_size AS x, p_retailprice AS y FROM part), m AS (SELECT c, avg(x) AS mx, avg(y) AS my FROM r GROUP BY 1),
s AS (SELECT r.c, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS s FROM r JOIN m ON r.c = m.c GROUP BY 1), o AS (SELECT m.c, mx, my, s FROM m JOIN s ON m.c = s.c),
w AS (SELECT a.c, max((a.s + b.s) / sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my))) AS r FROM o a JOIN o b ON a.c <> b.c GROUP BY 1) SELECT count(*) AS clusters, round(avg(r), 4) AS davies_bouldin FROM w""")
def _(spark, d):
    rows = table(spark, d, "part").select(*_C, F.substring("p_brand", 7, 9).cast("int").alias("cluster"))
    return ml.davies_bouldin(rows, _C)


@query("ml_cross_validate")
def _(spark, d):
    _, train, _ = _ready(spark, d)
    return ml.cross_validate(ml.folds(train, "doc_id", 3, "label").select("features", "label", "fold"), ml.classifier("decision_tree"), True, 3)


@query("ml_tune")
def _(spark, d):
    _, train, _ = _ready(spark, d)
    tree = ml.classifier("decision_tree")
    return ml.tune(train.select("features", "label"), tree, {"maxDepth": [2, 3, 4, 5, 6], "minInstancesPerNode": [1, 2, 5]}, MulticlassClassificationEvaluator(metricName="f1"), 5)[1]


# a simple rule as a classifier, so that SQL can score it too
_RULED = "SELECT l.quality AS label, CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END AS prediction, CAST(d.n_chars AS DOUBLE) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_CONF = f"p AS ({_RULED}), c AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT label, sum(n) AS support, coalesce(sum(n) FILTER (label = prediction), 0) AS tp FROM c GROUP BY 1), q AS (SELECT prediction AS label, sum(n) AS predicted FROM c GROUP BY 1), r AS (SELECT s.label, support, tp, coalesce(tp / predicted, 0) AS p, tp / support AS r FROM s LEFT JOIN q ON q.label = s.label)"


@query("ml_confusion", f"WITH {_CONF} SELECT label, prediction, n AS count FROM c")
def _(spark, d):
    return ml.confusion(derived(spark, d, _RULED))


@query("ml_class_report", f"WITH {_CONF} SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, CAST(support AS BIGINT) AS support FROM r")
def _(spark, d):
    return ml.class_report(derived(spark, d, _RULED))


@query("ml_eval_classification", f"WITH {_CONF} SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(sum(p * support) / sum(support), 4) AS precision, round(sum(r * support) / sum(support), 4) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 4) AS f1, CAST(sum(support) AS BIGINT) AS rows FROM r")
def _(spark, d):
    return ml.evaluate_classification(derived(spark, d, _RULED))


@query("ml_roc", f"WITH p AS ({_RULED}), k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM p), s AS (SELECT sum(r) FILTER (label = 1) AS w, CAST(sum(label) AS BIGINT) AS p, CAST(count(*) - sum(label) AS BIGINT) AS n FROM k) SELECT round((w - p * (p + 1) / 2) / (p * n), 6) AS auc, p AS positives, n AS negatives FROM s")
def _(spark, d):
    return ml.roc_auc(derived(spark, d, _RULED))


_GUESSED = "SELECT l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem"


@query("ml_eval_regression", f"WITH p AS ({_GUESSED}), e AS (SELECT label AS y, label - prediction AS e FROM p) SELECT round(avg(abs(e)), 2) AS mae, round(sqrt(avg(e * e)), 2) AS rmse, round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(100 * avg(CASE WHEN y <> 0 THEN abs(e / y) END), 2) AS mape, round(avg(e), 2) AS residual_mean, round(stddev_pop(e), 2) AS residual_std, count(*) AS rows FROM e")
def _(spark, d):
    out = ml.evaluate_regression(derived(spark, d, _GUESSED))
    return out.select(*[F.round(c, 4 if c == "r2" else 2).alias(c) for c in ("mae", "rmse", "r2", "mape", "residual_mean", "residual_std")], "rows")


@query("ml_importance")
def _(spark, d):
    _, train, _ = _ready(spark, d)
    return ml.importance(ml.classifier("random_forest").fit(train), train)


@query("ml_permutation_importance")
def _(spark, d):
    rows = derived(spark, d, _PRICE).withColumn("label", F.col("price"))
    from pyspark.ml import Pipeline

    names = ["l_quantity", "l_discount", "l_tax"]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), ml.regressor("linear")]).fit(rows)
    return ml.permutation_importance(model, rows, names, "row_id", RegressionEvaluator(metricName="r2"))


_WEIGHTS = {"l_quantity": 2.0, "l_discount": -30.0, "l_tax": 10.0}


@query("ml_contributions", """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, 'l_quantity' AS feature, round(l_quantity * 2.0, 6) AS contribution FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_discount', round(l_discount * -30.0, 6) FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_tax', round(l_tax * 10.0, 6) FROM lineitem),
k AS (SELECT row_id, row_number() OVER (PARTITION BY row_id, feature ORDER BY contribution) AS i, feature, contribution FROM r) SELECT feature, count(*) AS n, round(sum(contribution), 2) AS total FROM k GROUP BY 1""")
def _(spark, d):
    out = ml.contributions(derived(spark, d, _PRICE), "row_id", _WEIGHTS)
    return out.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("contribution"), 2).alias("total"))


@query("ml_leaderboard")
def _(spark, d):
    rows = ml.split(learn(spark, d).withColumn("label", F.col("quality").cast("double")), "doc_id", "quality")
    return ml.leaderboard(rows.where("part = 'train'"), rows.where("part = 'test'"), ml.preprocessor(["n_chars", "spaces", "stops", "stars"], ["lang"]), ["logistic", "decision_tree", "svm"], True)[0]


@query("ml_predict_batch")
def _(spark, d):
    from pyspark.ml import Pipeline, PipelineModel

    rows = learn(spark, d).withColumn("label", F.col("quality").cast("double"))
    pipeline = Pipeline(stages=[*ml.preprocessor(["n_chars", "spaces"], ["lang"]).getStages(), ml.classifier("decision_tree")])
    path = scratch(spark, "model")
    ml.save_models({"tree": pipeline.fit(rows)}, path)
    return ml.predict_batch(PipelineModel.load(f"{path}/tree"), rows, "doc_id", ["low", "high"]).select("doc_id", "predicted_label", F.col("probabilities")["high"].alias("p_high"))


@query("ml_save", "SELECT m.name AS model, count(*) AS rows, count(*) AS same FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('decision_tree'), ('logistic')) m(name) GROUP BY 1")
def _(spark, d):
    """Two candidates saved and loaded again: rows scored, and rows with the same prediction as before."""
    from functools import reduce

    from pyspark.ml import Pipeline, PipelineModel

    rows = learn(spark, d).withColumn("label", F.col("quality").cast("double"))
    names = ["decision_tree", "logistic"]
    models = {n: Pipeline(stages=[*ml.preprocessor(["n_chars", "spaces"], ["lang"]).getStages(), ml.classifier(n)]).fit(rows) for n in names}
    path = scratch(spark, "models")
    ml.save_models(models, path)
    both = lambda n: models[n].transform(rows).select("doc_id", F.col("prediction").alias("before")).join(PipelineModel.load(f"{path}/{n}").transform(rows).select("doc_id", "prediction"), "doc_id")
    return reduce(DataFrame.union, [both(n).agg(F.lit(n).alias("model"), F.count("*").alias("rows"), F.count_if(F.col("before") == F.col("prediction")).alias("same")) for n in names])


@query("ml_card", f"WITH {_REG}, s AS (SELECT o_orderstatus AS model_id, round(avg(o_totalprice), 2) AS h FROM orders GROUP BY 1) SELECT version_id, name, algorithm, 'accuracy' AS metric, accuracy AS holdout, h AS cv_mean FROM reg JOIN s USING (model_id)")
def _(spark, d):
    rows = versions(spark, d)
    cv = derived(spark, d, "SELECT o_orderstatus AS model_id, round(avg(o_totalprice), 2) AS cv_mean FROM orders GROUP BY 1")
    metrics = rows.join(cv, "model_id").select("version_id", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("holdout"), "cv_mean")
    return ml.model_card(rows, metrics)
