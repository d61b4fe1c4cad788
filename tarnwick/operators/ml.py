"""Machine learning on tables: targets, problem type, leakage, splits, preprocessing, models, evaluation, tuning, batch scoring."""

from __future__ import annotations

import itertools
import random
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import any_match, correlation, normalize_nulls
from ..functions.ranges import running_sums
from . import density

#: Names of likely targets, and of columns that are none.
TARGET_NAMES = ["^target$", "^label$", "^class$", "^outcome$", "churn", "default", "fraud", "converted", "price", "sales", "revenue", "profit", "cost", "demand", "salary", "status_flag"]
NOT_TARGETS = ["^id$", "_id$", "^id_", "uuid", "guid", "created_at", "updated_at", "timestamp", "date", "email", "phone", "name"]
#: Names of identifiers and of what is known only later.
LEAK_IDS = ["^id$", "_id$", "^id_", "uuid", "guid", "customer_id", "user_id", "order_id", "ssn", "account_number", "phone", "email"]
LEAK_FUTURE = ["churn_date", "cancellation_date", "exit_interview", "end_date", "resolution_time", "refund_amount"]


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def targets(df: DataFrame) -> DataFrame:
    """``(column, confidence, suggested_type, unique_count, null_count)`` of candidate targets: 0.55 for the name, 0.15 and 0.05 for the last and last but one place, 0.25 for two values, 0.15 for up to 20, 0.20 for numbers of more; within 0.20 and 0.99."""
    df = normalize_nulls(df)
    parts = []
    for i, f in enumerate(df.schema):
        if any_match(f.name, NOT_TARGETS):
            continue
        base = 0.55 * any_match(f.name, TARGET_NAMES) + {1: 0.15, 2: 0.05}.get(len(df.columns) - i, 0.0)
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(base).alias("base"), F.lit(_is_number(f.dataType)).alias("number"), F.count_distinct(f.name).alias("u"), F.count_if(F.col(f.name).isNull()).alias("null_count")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, confidence double, suggested_type string, unique_count bigint, null_count bigint")
    rows = df.agg(F.array(*parts).alias("c")).select(F.inline("c")).where("u > 0")
    u = F.col("u")
    more = F.when(u == 2, 0.25).when(u.between(3, 20), 0.15).when(F.col("number") & (u > 20), 0.20).otherwise(0.0)
    kind = F.when(u == 2, "binary_classification").when(u.between(3, 20), "multiclass_classification").when(F.col("number") & (u > 20), "regression").otherwise("classification")
    return rows.select("column", F.least(F.lit(0.99), F.greatest(F.lit(0.20), F.round(F.col("base") + more, 2))).alias("confidence"), kind.alias("suggested_type"), u.alias("unique_count"), "null_count")


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """``(problem_type, classes, rows, minority_pct, imbalanced)``: two classes are binary (imbalanced from 25 % down), texts or up to 20 values multiclass (imbalanced under 100 / (2 k) percent among the ten largest), else regression."""
    number = _is_number(df.schema[target].dataType)
    counts = normalize_nulls(df).where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), target).limit(10)
    whole = counts.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("n").alias("least"))
    least = top.agg(F.min("n").alias("top_least"))
    k, rows = F.col("classes"), F.col("rows")
    kind = F.when(k == 2, "binary_classification").when((k <= 20) | F.lit(not number), "multiclass_classification").otherwise("regression")
    pct = F.round(100 * F.try_divide(F.when(k == 2, F.col("least")).otherwise(F.col("top_least")), rows), 2)
    imbalanced = F.when(k == 2, pct <= 25).when(kind == "multiclass_classification", pct < 100 / (2 * F.least(k, F.lit(10)))).otherwise(F.lit(False))
    return whole.crossJoin(F.broadcast(least)).select(kind.alias("problem_type"), "classes", "rows", F.when(kind != "regression", pct).alias("minority_pct"), F.coalesce(imbalanced, F.lit(False)).alias("imbalanced"))


def _few_values(df: DataFrame, columns: list[str], most: int = 500) -> dict[str, int]:
    """How many different values each of ``columns`` has, or ``most`` + 1 where there are more. A task sends on no more than that many hashes of a column, so no column's values are shuffled whole."""

    def first(batches):
        seen: dict[str, set] = {c: set() for c in columns}
        for batch in batches:
            for i, c in enumerate(columns):
                if len(seen[c]) <= most:
                    new = set(pc.unique(batch.column(i)).to_pylist()) - {None} - seen[c]
                    new = set(itertools.islice(new, most + 1 - len(seen[c])))
                    seen[c] |= new
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array([c] * len(new)), pa.array(list(new), pa.int64())], ["column", "h"])
            if all(len(s) > most for s in seen.values()):
                return

    if not columns:
        return {}
    hashes = df.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`"))).alias(c) for c in columns])
    found = hashes.mapInArrow(first, "column string, h bigint").groupBy("column").agg(F.least(F.count_distinct("h"), F.lit(most + 1)).alias("n")).collect()
    return {c: 0 for c in columns} | {r["column"]: r["n"] for r in found}


def leakage(df: DataFrame, target: str) -> DataFrame:
    """``(column, risk, severity)``: a name derived from the target, an identifier (ratio over 0.85 or more than 500 values), a name of the future, |r| of 0.98 or more with the target (a text target by the rank of its value)."""
    df = normalize_nulls(df)
    spark = df.sparkSession
    low = target.lower().strip()
    if _is_number(df.schema[target].dataType):
        coded, code = df, F.col(target).cast("double")
    else:
        ranks = df.where(F.col(target).isNotNull()).select(target).distinct().withColumn("code_", F.dense_rank().over(Window.orderBy(target)))
        coded = df.join(F.broadcast(ranks), target, "left")
        code = F.col("code_").cast("double")
    named, parts = [], []
    values = _few_values(df, [f.name for f in df.schema if f.name != target and any_match(f.name, LEAK_IDS)])
    for f in df.schema:
        c = f.name
        if c == target:
            continue
        n = c.lower().strip()
        if n.startswith(low + "_") or n.endswith("_" + low) or n == f"is_{low}" or f"{low}_flag" in n or f"{low}_status" in n:
            named.append((c, "TARGET_DERIVED_FEATURE", "CRITICAL"))
        if any_match(c, LEAK_FUTURE):
            named.append((c, "FUTURE_INFORMATION", "HIGH"))
        r = correlation(F.col(c).cast("double"), code) if _is_number(f.dataType) else F.lit(None).cast("double")
        is_id = (F.lit(values[c]) / F.greatest(F.count(c), F.lit(1)) > 0.85) | F.lit(values[c] > 500) if c in values else F.lit(False)
        parts.append(F.struct(F.lit(c).alias("column"), is_id.alias("is_id"), r.alias("r"), F.count(c).alias("n")))
    rows = coded.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    by_name = spark.createDataFrame(named, "column string, risk string, severity string")
    ids = rows.where("is_id").select("column", F.lit("UNIQUE_IDENTIFIER").alias("risk"), F.lit("HIGH").alias("severity"))
    near = rows.where("abs(r) >= 0.98 and n >= 10").select("column", F.lit("NEAR_PERFECT_CORRELATION").alias("risk"), F.lit("CRITICAL").alias("severity"))
    return reduce(DataFrame.union, [by_name, ids, near])


def feature_types(schema: DataFrame, target: str, excluded: list[str] | None = None) -> DataFrame:
    """``(column, role)`` from a schema report: numerical, categorical (booleans and texts too), datetime, or dropped (identifiers, unknown, excluded)."""
    t = F.col("inferred_type")
    role = F.when(F.col("column").isin(excluded or []), "dropped").when(t == "NUMERICAL", "numerical").when(t == "DATETIME", "datetime").when(t.isin("CATEGORICAL", "BOOLEAN", "TEXT"), "categorical").otherwise("dropped")
    return schema.where(F.col("column") != target).select("column", role.alias("role"))


def datetime_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Year, month, day and day of week (Monday 0) of each column; NULL gives 2020, 1, 1 and 0."""
    out = {}
    for c in columns:
        out |= {f"{c}_year": F.coalesce(F.year(c), F.lit(2020)), f"{c}_month": F.coalesce(F.month(c), F.lit(1)), f"{c}_day": F.coalesce(F.day(c), F.lit(1)), f"{c}_dayofweek": F.coalesce(F.weekday(c), F.lit(0))}
    return df.withColumns(out).drop(*columns)


def preprocessor(numerical: list[str], categorical: list[str], scale: bool = True) -> Pipeline:
    """Median and scaling of numbers; texts with a class of their own for the missing and unknown, one-hot; all in ``features``. Fit it on the training part only."""
    stages: list = []
    blocks = []
    if numerical:
        stages += [Imputer(inputCols=numerical, outputCols=[f"{c}__i" for c in numerical], strategy="median"), VectorAssembler(inputCols=[f"{c}__i" for c in numerical], outputCol="numbers__", handleInvalid="keep")]
        blocks.append("numbers__")
        if scale:
            stages.append(StandardScaler(inputCol="numbers__", outputCol="scaled__", withMean=True))
            blocks[-1] = "scaled__"
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}__x" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}__x" for c in categorical], outputCols=[f"{c}__h" for c in categorical], handleInvalid="keep", dropLast=False)]
        blocks += [f"{c}__h" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=blocks, outputCol="features", handleInvalid="keep")])


def split(df: DataFrame, key: str, stratify: str | None = None, share: float = 0.2) -> DataFrame:
    """``part``: ``test`` for the share of each class (or of all) whose key's md5 ranks first, else ``train``; the same on every run.

    Ranks are taken in 256 buckets by the digest's first byte, then by bucket counts, so no class is in one task.
    """
    by = [F.col(stratify)] if stratify else [F.lit(0)]
    h = F.md5(F.col(key).cast("string"))
    rows = df.withColumns({"h_": h, "g_": by[0], "b_": F.substring(h, 1, 2)})
    own = F.row_number().over(Window.partitionBy("g_", "b_").orderBy("h_", key))
    sizes = rows.groupBy("g_", "b_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy("g_")
    sizes = sizes.select(F.col("g_").alias("g2_"), F.col("b_").alias("b2_"), (F.sum("n_").over(w.orderBy("b_")) - F.col("n_")).alias("before_"), F.sum("n_").over(w).alias("all_"))
    joined = rows.withColumn("r_", own).join(F.broadcast(sizes), F.col("g_").eqNullSafe(F.col("g2_")) & (F.col("b_") == F.col("b2_")))
    return joined.select(*df.columns, F.when(F.col("r_") + F.col("before_") <= F.round(F.col("all_") * share), "test").otherwise("train").alias("part"))


def baseline(parts: DataFrame, target: str, classification: bool = True) -> DataFrame:
    """``(prediction, metric, value)`` on the test part: accuracy of the most frequent training class (the least of equal ones), or RMSE of the training mean."""
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    if classification:
        guess = train.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n")).agg(F.min_by(target, F.struct((-F.col("n")).alias("n"), target)).alias("guess"))
        return test.crossJoin(F.broadcast(guess)).agg(F.first("guess").cast("string").alias("prediction"), F.lit("accuracy").alias("metric"), F.round(F.avg((F.col(target) == F.col("guess")).cast("int")), 4).alias("value"))
    guess = train.agg(F.avg(target).alias("guess"))
    e = F.col(target) - F.col("guess")
    return test.crossJoin(F.broadcast(guess)).agg(F.round(F.first("guess"), 4).cast("string").alias("prediction"), F.lit("rmse").alias("metric"), F.round(F.sqrt(F.avg(e * e)), 4).alias("value"))


def improvement(value: Column, base: Column, lower_better: bool) -> Column:
    """Percent better than the baseline."""
    gain = (base - value) if lower_better else (value - base)
    return F.round(100 * gain / F.when(F.abs(base) > 1e-9, F.abs(base)).otherwise(1e-9), 2)


def classifier(name: str, label: str = "label", classes: int = 2, **params):
    """An estimator by name: logistic, random_forest, gbt, hist_gbt, decision_tree, svm; those for two classes go one against the rest beyond."""
    two = {
        "gbt": lambda: GBTClassifier(labelCol=label, maxIter=50, maxDepth=4, seed=42, **params),
        "hist_gbt": lambda: GBTClassifier(labelCol=label, maxIter=50, maxBins=255, seed=42, **params),
        "svm": lambda: LinearSVC(labelCol=label, **params),
    }
    if name in two:
        return two[name]() if classes == 2 else OneVsRest(labelCol=label, classifier=two[name]())
    return {
        "logistic": lambda: LogisticRegression(labelCol=label, maxIter=100, **params),
        "random_forest": lambda: RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=8, seed=42, **params),
        "decision_tree": lambda: DecisionTreeClassifier(labelCol=label, maxDepth=6, seed=42, **params),
    }[name]()


def regressor(name: str, label: str = "label", **params):
    """An estimator by name: linear, ridge, lasso, random_forest, gbt, hist_gbt, decision_tree."""
    return {
        "linear": lambda: LinearRegression(labelCol=label, **params),
        "ridge": lambda: LinearRegression(labelCol=label, **({"regParam": 1.0, "elasticNetParam": 0.0} | params)),
        "lasso": lambda: LinearRegression(labelCol=label, **({"regParam": 0.1, "elasticNetParam": 1.0} | params)),
        "random_forest": lambda: RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=8, seed=42, **params),
        "gbt": lambda: GBTRegressor(labelCol=label, maxIter=50, maxDepth=4, seed=42, **params),
        "hist_gbt": lambda: GBTRegressor(labelCol=label, maxIter=50, maxBins=255, seed=42, **params),
        "decision_tree": lambda: DecisionTreeRegressor(labelCol=label, maxDepth=6, seed=42, **params),
    }[name]()


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_"))
    whole = counts.agg(F.sum("n_").alias("all_"), F.count("*").alias("k_"))
    return df.join(F.broadcast(counts.crossJoin(F.broadcast(whole)).select(label, (F.col("all_") / (F.col("k_") * F.col("n_"))).alias("weight"))), label)


def cluster(df: DataFrame, name: str = "kmeans", k: int = 3, features: str = "features") -> DataFrame:
    """Adds ``cluster`` by kmeans or bisecting (top-down for the agglomerative)."""
    model = (KMeans if name == "kmeans" else BisectingKMeans)(k=k, seed=42, featuresCol=features, predictionCol="cluster")
    return model.fit(df).transform(df)


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """``(key, cluster)``: density clusters; a cluster goes by its least core key, noise is -1; a border point joins its least neighbour core's. Keys are compared as texts; rows with a null or endless coordinate are noise. For few columns: cells are found by two of them."""
    return density.clusters(df, key, columns, eps, least)


def silhouette(df: DataFrame, features: str = "features") -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(df)


def davies_bouldin(df: DataFrame, columns: list[str], cluster_: str = "cluster") -> DataFrame:
    """``(clusters, davies_bouldin)``: the mean over clusters of the worst ratio of both spreads to the centres' distance; cluster -1 is noise."""
    rows = df.where(F.col(cluster_) != -1).select(F.col(cluster_).alias("c"), *columns)
    centres = rows.groupBy("c").agg(*[F.avg(x).alias(f"m_{x}") for x in columns])
    gap = lambda a, b: F.sqrt(reduce(lambda p, q: p + q, [(F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in columns]))
    spread = rows.join(F.broadcast(centres), "c").groupBy("c").agg(F.avg(gap("", "m_")).alias("s"))
    own = centres.join(spread, "c")
    other = own.toDF("d", *[f"o_{x}" for x in columns], "t")
    worst = own.join(F.broadcast(other), F.col("c") != F.col("d")).groupBy("c").agg(F.max(F.try_divide(F.col("s") + F.col("t"), gap("m_", "o_"))).alias("r"))
    return worst.agg(F.count("*").alias("clusters"), F.round(F.avg("r"), 4).alias("davies_bouldin"))


def folds(df: DataFrame, key: str, k: int = 5, stratify: str | None = None) -> DataFrame:
    """``fold``, 0 to k - 1, by the md5 rank within each class, counted in 4096 buckets of the hash and carried from bucket to bucket: no task holds a class, and the folds of a class differ by one row at most."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    of = [F.coalesce(F.col(stratify).cast("string"), F.lit("")) if stratify else F.lit("")]
    rows = df.withColumns({"fold_class_": of[0], "fold_bucket_": F.substring(digest, 1, 3)})
    counts = rows.groupBy("fold_class_", "fold_bucket_").agg(F.count("*").alias("fold_n_"))
    carried = counts.select("fold_class_", "fold_bucket_", (F.sum("fold_n_").over(Window.partitionBy("fold_class_").orderBy("fold_bucket_")) - F.col("fold_n_")).alias("fold_before_"))
    rank = F.row_number().over(Window.partitionBy("fold_class_", "fold_bucket_").orderBy(digest, key))
    ranked = rows.withColumn("fold_rank_", rank).join(carried, ["fold_class_", "fold_bucket_"])
    return ranked.withColumn("fold", F.pmod(F.col("fold_rank_") + F.col("fold_before_"), F.lit(k)).cast("int")).select(*df.columns, "fold")


def cross_validate(df: DataFrame, estimator, classification: bool, k: int = 5, label: str = "label") -> DataFrame:
    """``(metric, mean, std)`` over the folds of ``fold``: one fit a fold, all metrics from one aggregate; RMSE is positive."""
    parts = []
    for fold in range(k):
        model = estimator.fit(df.where(F.col("fold") != fold))
        pairs = model.transform(df.where(F.col("fold") == fold)).select(F.col(label).alias("label"), "prediction")
        parts.append((evaluate_classification(pairs) if classification else evaluate_regression(pairs)).drop("rows"))
    every = reduce(DataFrame.unionByName, parts)
    names = every.columns
    stats = every.agg(*[F.struct(F.lit(c).alias("metric"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std")).alias(c) for c in names])
    return stats.select(F.inline(F.array(*names)))


def tune(df: DataFrame, estimator, ranges: dict[str, list], evaluator, trials: int = 15, seed: int = 42, parallelism: int = 2):
    """The best model of ``trials`` seeded draws from ``ranges`` (parameter name to values), and the table of draws and scores."""
    draw = random.Random(seed)
    maps, rows = [], []
    for _ in range(trials):
        values = {n: draw.choice(v) for n, v in ranges.items()}
        if values not in rows:
            rows.append(values)
            maps.append({estimator.getParam(n): v for n, v in values.items()})
    fitted = TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps or ParamGridBuilder().build(), evaluator=evaluator, trainRatio=0.8, seed=seed, parallelism=parallelism).fit(df)
    table = df.sparkSession.createDataFrame([(i, {n: str(v) for n, v in r.items()}, float(s)) for i, (r, s) in enumerate(zip(rows, fitted.validationMetrics))], "trial int, params map<string,string>, score double")
    return fitted.bestModel, table


def confusion(pairs: DataFrame) -> DataFrame:
    """``(label, prediction, count)`` of ``(label, prediction)``."""
    return pairs.groupBy("label", "prediction").agg(F.count("*").alias("count"))


def class_report(pairs: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)`` for each class."""
    c = confusion(pairs)
    hit = c.where("label = prediction").select("label", F.col("count").alias("tp"))
    p = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    rows = c.groupBy("label").agg(F.sum("count").alias("support")).join(hit, "label", "left").join(p, "label", "left")
    tp = F.coalesce("tp", F.lit(0))
    precision, recall = F.coalesce(tp / F.col("predicted"), F.lit(0.0)), tp / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("label", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), "support")


def evaluate_classification(pairs: DataFrame) -> DataFrame:
    """``(accuracy, precision, recall, f1, rows)``, weighted by class."""
    c = confusion(pairs)
    hit = c.where("label = prediction").select("label", F.col("count").alias("tp"))
    p = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    rows = c.groupBy("label").agg(F.sum("count").alias("support")).join(hit, "label", "left").join(p, "label", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    rows = rows.withColumns({"p": F.coalesce(F.col("tp") / F.col("predicted"), F.lit(0.0)), "r": F.col("tp") / F.col("support")})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    n = F.sum("support")
    mean = lambda x, name: F.round(F.sum(x * F.col("support")) / n, 4).alias(name)
    return rows.agg(F.round(F.sum("tp") / n, 4).alias("accuracy"), mean(F.col("p"), "precision"), mean(F.col("r"), "recall"), mean(f1, "f1"), n.alias("rows"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """``(score, tpr, fpr)`` of ``(label 0/1, score)``, a point for each distinct score, the highest first."""
    by = scored.where("score is not null").groupBy("score").agg(F.sum("label").alias("p"), (F.count("*") - F.sum("label")).alias("n"))
    whole = by.agg(F.sum("p").alias("ap"), F.sum("n").alias("an"))
    run = running_sums(by, [], "score", ["p", "n"]).crossJoin(F.broadcast(whole))
    return run.withColumns({"tp": F.col("ap") - F.col("p_upto") + F.col("p"), "fp": F.col("an") - F.col("n_upto") + F.col("n")}).select("score", F.try_divide("tp", "ap").alias("tpr"), F.try_divide("fp", "an").alias("fpr"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """``(auc, positives, negatives)``: the chance that a positive scores above a negative, ties by half, from counts by distinct score."""
    by = scored.where("score is not null").groupBy("score").agg(F.sum("label").alias("p"), (F.count("*") - F.sum("label")).alias("n"))
    rows = running_sums(by, [], "score", ["n"]).withColumn("wins", F.col("p") * (F.col("n_upto") - F.col("n") / 2))
    return rows.agg(F.round(F.try_divide(F.sum("wins"), F.sum("p") * F.sum("n")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def evaluate_regression(pairs: DataFrame) -> DataFrame:
    """``(mae, mse, rmse, r2, mape, residual_mean, residual_std, rows)`` of ``(label, prediction)``."""
    e, y = F.col("label") - F.col("prediction"), F.col("label")
    r = lambda c, name: F.round(c, 4).alias(name)
    total = F.var_pop(y) * F.count(y)
    return pairs.where("label is not null and prediction is not null").agg(r(F.avg(F.abs(e)), "mae"), r(F.avg(e * e), "mse"), r(F.sqrt(F.avg(e * e)), "rmse"), r(F.when(total > 0, 1 - F.sum(e * e) / total), "r2"), r(100 * F.avg(F.when(y != 0, F.abs(e / y))), "mape"), r(F.avg(e), "residual_mean"), r(F.stddev_pop(e), "residual_std"), F.count("*").alias("rows"))


def slot_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the vector's slots from its ML attributes."""
    attrs = df.schema[features].metadata.get("ml_attr", {})
    named = sorted((a["idx"], a.get("name", f"f{a['idx']}")) for group in attrs.get("attrs", {}).values() for a in group)
    return [n for _, n in named] or [f"f{i}" for i in range(attrs.get("num_attrs", 0))]


def importance(model, df: DataFrame, features: str = "features") -> DataFrame:
    """``(feature, importance, rank)``: the trees' importances or the size of the coefficients, adding up to 1."""
    if hasattr(model, "featureImportances"):
        raw = [float(x) for x in model.featureImportances.toArray()]
    else:
        raw = [abs(float(x)) for x in (model.coefficients.toArray() if model.__class__.__name__ != "LogisticRegressionModel" else model.coefficientMatrix.toArray()[0])]
    total = sum(raw) or 1.0
    names = slot_names(df, features)
    names += [f"f{i}" for i in range(len(names), len(raw))]
    rows = sorted(zip(names, (x / total for x in raw)), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame([(n, round(v, 6), i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int")


def permutation_importance(model, df: DataFrame, columns: list[str], key: str, evaluator) -> DataFrame:
    """``(feature, drop)``: how much the score falls when a column's values change rows: each row takes the value of the next row in md5 order within 256 buckets."""
    base = evaluator.evaluate(model.transform(df))
    h = F.md5(F.col(key).cast("string"))
    w = Window.partitionBy(F.substring(h, 1, 2)).orderBy(h, key)
    out = [(c, float(base - evaluator.evaluate(model.transform(df.withColumn(c, F.coalesce(F.lead(c).over(w), F.first(c).over(w))))))) for c in columns]
    return df.sparkSession.createDataFrame(out, "feature string, drop double")


def contributions(df: DataFrame, key: str, weights: dict[str, float], k: int = 8) -> DataFrame:
    """``(key, feature, contribution, rank)``: value times weight, the ``k`` largest by size, ties by name."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w, 6).alias("contribution")) for c, w in weights.items()])
    order = F.array_sort(F.transform(parts, lambda p: F.struct((-F.abs(p["contribution"])).alias("s"), p["feature"].alias("feature"), p["contribution"].alias("contribution"))))
    return df.select(F.col(key), F.posexplode(F.slice(order, 1, k)).alias("pos", "p")).select(key, "p.feature", "p.contribution", (F.col("pos") + 1).alias("rank"))


def leaderboard(train: DataFrame, test: DataFrame, prepared: Pipeline, names: list[str], classification: bool, label: str = "label", classes: int = 2) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """``(model, metric values..., rank, is_best)`` of candidates fitted on one preprocessed training set, by F1 or RMSE on the test part; and the fitted pipelines."""
    fitted = prepared.fit(train)
    ready, held = fitted.transform(train).cache(), fitted.transform(test).cache()
    rows, models = [], {}
    for name in names:
        estimator = classifier(name, label, classes) if classification else regressor(name, label)
        model = estimator.fit(ready)
        models[name] = PipelineModel(stages=[*fitted.stages, model])
        pairs = model.transform(held).select(F.col(label).alias("label"), "prediction")
        rows.append((evaluate_classification(pairs) if classification else evaluate_regression(pairs)).withColumn("model", F.lit(name)))
    table = reduce(DataFrame.unionByName, rows)
    order = F.desc("f1") if classification else F.asc("rmse")
    rank = F.row_number().over(Window.orderBy(order, "model"))  # a row for each candidate
    out = table.withColumn("rank", rank).withColumn("is_best", F.col("rank") == 1)
    out = out.sparkSession.createDataFrame(out.collect(), out.schema)
    ready.unpersist()
    held.unpersist()
    return out, models


def predict_batch(model: PipelineModel, df: DataFrame, key: str, labels: list[str] | None = None) -> DataFrame:
    """``(key, prediction[, label, probabilities])``: class numbers are decoded by ``labels``."""
    out = model.transform(df)
    if labels is None:
        return out.select(key, F.round("prediction", 6).alias("prediction"))
    out = IndexToString(inputCol="prediction", outputCol="label_", labels=labels).transform(out)
    names = F.array(*[F.lit(x) for x in labels])
    probs = F.map_from_arrays(names, F.transform(vector_to_array("probability"), lambda p: F.round(p, 6))) if "probability" in out.columns else F.lit(None).cast("map<string,double>")
    return out.select(key, "prediction", F.col("label_").alias("predicted_label"), probs.alias("probabilities"))


def model_card(registry: DataFrame, metrics: DataFrame) -> DataFrame:
    """``(version_id, name, algorithm, metric, holdout, cv_mean)``: a version's row against its long metrics ``(version_id, metric, holdout, cv_mean)``."""
    return registry.select("version_id", "name", "algorithm").join(metrics, "version_id")


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
