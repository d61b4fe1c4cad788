"""Queries: schema, profile, quality, exploration, insights and audits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..operators import explore, profile, quality
from .base import MESSY, MESSY_COLUMNS, Section, derived, table

S = Section()
query = S.query

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_M = f"m AS ({MESSY})"
_COUNTS = "counts AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", CAST({n} AS VARCHAR) AS value, count(*) AS n FROM m GROUP BY 2" for n, *_ in MESSY_COLUMNS) + ")"
_NAMES = "names(position, \"column\", kind, dtype, id_name) AS (VALUES " + ", ".join(f"({i}, '{n}', '{k}', '{t}', {str(b).upper()})" for i, (n, k, t, b) in enumerate(MESSY_COLUMNS)) + ")"
_SCHEMA = rf"""{_M}, {_COUNTS}, {_NAMES},
stats AS (SELECT "column", sum(n) AS rows, coalesce(sum(n) FILTER (value IS NULL), 0) AS nulls, count(value) AS u, sum(length(value) * n) AS chars,
  coalesce(sum(n) FILTER (regexp_matches(value, '^\d{{4}}-\d{{2}}-\d{{2}}|^\d{{2}}/\d{{2}}/\d{{4}}|^\d{{4}}/\d{{2}}/\d{{2}}')), 0) AS dates,
  bool_and(lower(value) IN ('0','1','true','false','yes','no','t','f','y','n')) FILTER (value IS NOT NULL) AS truths FROM counts GROUP BY 1),
firsts AS (SELECT "column", string_agg(value, ',' ORDER BY value) AS samples FROM (SELECT * FROM counts WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY value) <= 5) GROUP BY 1),
schema_report AS (SELECT CAST(position AS INTEGER) AS position, "column", CASE
  WHEN rows = nulls THEN 'UNKNOWN' WHEN id_name AND (u / (rows - nulls) > 0.85 OR u > 500) THEN 'IDENTIFIER'
  WHEN kind = 'boolean' OR (u <= 2 AND truths) THEN 'BOOLEAN' WHEN kind = 'datetime' OR (kind = 'string' AND dates / (rows - nulls) > 0.8) THEN 'DATETIME'
  WHEN kind IN ('integer', 'float') AND u <= 10 AND u / (rows - nulls) < 0.05 AND NOT id_name THEN 'CATEGORICAL' WHEN kind IN ('integer', 'float') THEN 'NUMERICAL'
  WHEN chars / (rows - nulls) > 35 THEN 'TEXT' WHEN u <= 50 OR u / (rows - nulls) < 0.15 THEN 'CATEGORICAL' WHEN u / (rows - nulls) > 0.9 THEN 'IDENTIFIER' ELSE 'CATEGORICAL' END AS inferred_type,
  dtype, CAST(nulls AS BIGINT) AS null_count, round(100 * nulls / rows, 2) AS null_pct, CAST(u AS BIGINT) AS unique_count, round(100 * u / rows, 2) AS unique_pct, samples
  FROM names JOIN stats USING ("column") LEFT JOIN firsts USING ("column"))"""


def _messy(spark, d):
    return derived(spark, d, MESSY)


@query("detect_schema", f"WITH {_SCHEMA} SELECT * FROM schema_report")
def _(spark, d):
    return profile.detect_schema(_messy(spark, d))


@query("schema_summary", f"WITH {_SCHEMA} SELECT inferred_type, count(*) AS columns FROM schema_report GROUP BY 1")
def _(spark, d):
    return profile.schema_summary(profile.detect_schema(_messy(spark, d)))


def _tidy(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 1e6 THEN round({x}, 0) ELSE round({x}, 4) END"


@query("profile_numeric", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS uniques, {_tidy(f"min({c})")} AS min, {_tidy(f"max({c})")} AS max,
 {_tidy(f"avg({c})")} AS mean, {_tidy(f"quantile_cont({c}, 0.5)")} AS median, {_tidy(f"stddev_samp({c})")} AS std, {_tidy(f"var_samp({c})")} AS variance, {_tidy(f"quantile_cont({c}, 0.25)")} AS q25, {_tidy(f"quantile_cont({c}, 0.75)")} AS q75,
 {_tidy(f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")} AS iqr, round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis FROM lineitem""" for c in LINE))
def _(spark, d):
    return profile.profile_numeric(table(spark, d, "lineitem"), LINE)


def _hist_sql(view: str, columns: list[str], bins: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(i AS INTEGER) AS bin, round(a + (b - a) / k * i, 4) AS low, round(a + (b - a) / k * (i + 1), 4) AS high,
 (SELECT count(*) FROM {view} WHERE {c} IS NOT NULL AND least(floor(({c} - a) / (b - a) * k), k - 1) = i) AS count
 FROM (SELECT a, b, k, unnest(range(0, CAST(k AS BIGINT))) AS i FROM (SELECT min({c}) AS a, max({c}) AS b, {bins.format(c=c)} AS k FROM {view}))""" for c in columns)


@query("profile_histogram", _hist_sql("lineitem", ["l_quantity", "l_discount"], "least(15, greatest(5, count(DISTINCT {c})))"))
def _(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])


_BINS = _hist_sql("lineitem", LINE, "10")


@query("chart_hist", _BINS)
@query("distribution_bins", _BINS)
def _(spark, d):
    return explore.distribution_bins(table(spark, d, "lineitem"), LINE)


def _top_sql(view: str, columns: list[str], k: int) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(r AS INTEGER) AS rank, value, n AS count, round(100 * n / (SELECT count(*) FROM {view}), 2) AS pct, (SELECT count(DISTINCT {c}) FROM {view}) AS cardinality
 FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r FROM {view} WHERE {c} IS NOT NULL GROUP BY 1) WHERE r <= {k}""" for c in columns)


@query("profile_categorical", _top_sql("part", ["p_brand", "p_type", "p_size"], 10))
def _(spark, d):
    return profile.top_values(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


_TOP8 = _top_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"], 8)


@query("chart_bar", _TOP8)
@query("distribution_top", _TOP8)
def _(spark, d):
    return explore.distribution_top(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("profile_text", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(length({c})), 2) AS avg_length, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, count(*) FILTER (trim({c}) = '') AS blank_count FROM documents""" for c in ("text", "source")))
def _(spark, d):
    return profile.profile_text(table(spark, d, "documents"), ["text", "source"])


@query("profile_datetime", """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min, max(o_orderdate) AS max, CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) AS BIGINT) AS range_days FROM orders""")
def _(spark, d):
    return profile.profile_datetime(table(spark, d, "orders"), ["o_orderdate"]).select("column", F.col("min").cast("timestamp_ntz").alias("min"), F.col("max").cast("timestamp_ntz").alias("max"), "range_days")


@query("profile_dataset", "SELECT count(*) AS row_count, CAST(2 AS BIGINT) AS column_count, CAST(sum(strlen(n_name) + strlen(CAST(n_nationkey AS VARCHAR))) AS BIGINT) AS approx_bytes FROM nation")
def _(spark, d):
    return profile.profile_dataset(table(spark, d, "nation").select("n_name", "n_nationkey"))


_MISSING = """missing AS (SELECT "column", inferred_type, null_count, null_pct, CASE WHEN null_pct > 30 THEN 'CRITICAL' WHEN null_pct > 10 THEN 'HIGH' WHEN null_pct > 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM schema_report WHERE null_count > 0)"""


@query("quality_missing", f"WITH {_SCHEMA}, {_MISSING} SELECT * FROM missing")
def _(spark, d):
    return quality.missing(profile.detect_schema(_messy(spark, d)))


@query("quality_duplicates", f"WITH {_M} SELECT count(*) - count(DISTINCT email) AS duplicate_rows FROM m")
def _(spark, d):
    return quality.duplicates(_messy(spark, d), ["order_id", "email"])


_CONSTANT = """constants AS (SELECT "column", CASE WHEN count(*) = 1 THEN 'constant' ELSE 'near_constant' END AS kind, round(max(n) / sum(n), 4) AS top_share FROM counts WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) = 1 OR max(n) / sum(n) >= 0.99)"""


@query("quality_constant", f"WITH {_M}, {_COUNTS}, {_CONSTANT} SELECT * FROM constants")
def _(spark, d):
    return quality.constants(_messy(spark, d))


def _outlier_sql(view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers, round(100 * count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) / count(*), 2) AS pct, round(max(a - 1.5 * (b - a)), 3) AS low, round(max(b + 1.5 * (b - a)), 3) AS high
 FROM {view}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {view})) WHERE outliers > 0""" for c in columns)


@query("quality_outliers", _outlier_sql("events", ["value", "user_id"]))
def _(spark, d):
    return quality.outliers(table(spark, d, "events"), ["value", "user_id"])


@query("quality_skewed", """SELECT "column", s AS skewness, CASE WHEN s > 0 THEN 'right' ELSE 'left' END AS direction FROM (SELECT 'value' AS "column", round(skewness(value), 3) AS s FROM events UNION ALL SELECT 'user_id', round(skewness(user_id), 3) FROM events) WHERE abs(s) > 1""")
def _(spark, d):
    return quality.skewed(table(spark, d, "events"), ["value", "user_id"])


_INVALID = rf"""invalid AS (SELECT 'customer_age' AS "column", 'age_range' AS rule, count(*) FILTER (customer_age < 0 OR customer_age > 130) AS invalid_count FROM m
 UNION ALL SELECT 'email', 'email_format', count(*) FILTER (NOT regexp_matches(trim(email), '{quality.EMAIL}')) FROM m)"""


@query("quality_invalid", f"WITH {_M}, {_INVALID} SELECT * FROM invalid WHERE invalid_count > 0")
def _(spark, d):
    df = _messy(spark, d)
    return quality.invalid(df, quality.default_rules(df.columns))


_SCORE = f"""WITH {_SCHEMA}, {_CONSTANT}, {_INVALID}, outl AS ({_outlier_sql("m", ["price", "customer_age"])}),
c AS (SELECT (SELECT count(*) FROM m) AS r, CAST(9 AS DOUBLE) AS k, (SELECT sum(null_count) FROM schema_report) AS nulls, (SELECT count(*) - count(DISTINCT email) FROM m) AS dup, (SELECT sum(invalid_count) FROM invalid) AS bad,
  (SELECT count(*) FROM constants WHERE kind = 'constant') AS flat, (SELECT coalesce(sum(outliers), 0) FROM outl) AS o),
p AS (SELECT greatest(0, 100 - 100 * nulls / (r * k)) AS a, greatest(0, 100 - 200 * dup / r) AS b, greatest(0, 100 - 300 * bad / (r * k)) AS v, greatest(0, 100 - 250 * flat / k) AS s, greatest(0, 100 - 150 * o / (r * k)) AS e FROM c),
scored AS (SELECT round(a, 1) AS completeness, round(b, 1) AS uniqueness, round(v, 1) AS validity, round(s, 1) AS consistency, round(e, 1) AS outlier_score, round(0.35 * a + 0.25 * b + 0.2 * v + 0.1 * s + 0.1 * e, 1) AS overall_score,
  CASE WHEN 0.35 * a + 0.25 * b + 0.2 * v + 0.1 * s + 0.1 * e >= 90 THEN 'A' WHEN 0.35 * a + 0.25 * b + 0.2 * v + 0.1 * s + 0.1 * e >= 80 THEN 'B' WHEN 0.35 * a + 0.25 * b + 0.2 * v + 0.1 * s + 0.1 * e >= 70 THEN 'C' ELSE 'D' END AS grade FROM p)"""


def scored(spark, d) -> DataFrame:
    df = _messy(spark, d)
    return quality.score_table(df, profile.detect_schema(df), ["order_id", "email"], ["price", "customer_age"])


@query("quality_score", f"{_SCORE} SELECT * FROM scored")
def _(spark, d):
    return scored(spark, d)


@query("quality_readiness", f"{_SCORE} SELECT overall_score, CASE WHEN overall_score >= 80 THEN 'READY' WHEN overall_score >= 60 THEN 'WARNING' ELSE 'UNFIT' END AS readiness FROM scored")
def _(spark, d):
    return quality.readiness(scored(spark, d))


@query("quality_recommendations", f"""WITH {_SCHEMA}, {_MISSING}, {_CONSTANT}, outl AS ({_outlier_sql("m", ["price", "customer_age"])})
SELECT "column", CASE WHEN null_pct > 60 THEN 'HIGH_MISSINGNESS' WHEN inferred_type = 'NUMERICAL' THEN 'NUMERICAL_MISSINGNESS' ELSE 'CATEGORICAL_MISSINGNESS' END AS issue_type, CASE WHEN null_pct > 60 THEN 'HIGH' WHEN inferred_type = 'NUMERICAL' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN null_pct > 60 THEN 'DROP_COLUMN' WHEN inferred_type = 'NUMERICAL' THEN 'MEDIAN_IMPUTE' ELSE 'MODE_IMPUTE' END AS action FROM missing WHERE null_pct > 60 OR inferred_type IN ('NUMERICAL', 'CATEGORICAL', 'TEXT')
UNION ALL SELECT "column", 'ZERO_VARIANCE', 'MEDIUM', 'DROP_COLUMN' FROM constants WHERE kind = 'constant'
UNION ALL SELECT NULL, 'DUPLICATE_RECORDS', 'MEDIUM', 'DEDUPLICATE' FROM (SELECT count(*) - count(DISTINCT email) AS n FROM m) WHERE n > 0
UNION ALL SELECT "column", 'NUMERICAL_OUTLIERS', 'LOW', 'INVESTIGATE_AND_CLIP' FROM outl WHERE pct > 2""")
def _(spark, d):
    df = _messy(spark, d)
    return quality.recommendations(quality.missing(profile.detect_schema(df)), quality.constants(df), quality.duplicates(df, ["order_id", "email"]), quality.outliers(df, ["price", "customer_age"]))


_WIDE = "SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, round(l_extendedprice * (1 - l_discount), 2) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS gross, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS tax FROM lineitem"
_WIDE_COLUMNS = ["quantity", "price", "discount", "net", "gross", "tax"]


def _corr_sql(columns: list[str], view: str = "w") -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(coalesce(corr({a}, {b}), 0), 3) AS r FROM {view}" for a, b in combinations(columns, 2))


_PAIRS = f"WITH w AS ({_WIDE}), pairs AS ({_corr_sql(_WIDE_COLUMNS)})"


def pairs(spark, d) -> DataFrame:
    return explore.correlations(derived(spark, d, _WIDE), _WIDE_COLUMNS)


_MATRIX = f"{_PAIRS} SELECT * FROM pairs UNION ALL SELECT column_b, column_a, r FROM pairs UNION ALL SELECT c, c, 1.0 FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in _WIDE_COLUMNS)}) v(c)"


@query("chart_heatmap", _MATRIX)
@query("correlation_matrix", _MATRIX)
def _(spark, d):
    return explore.correlation_matrix(pairs(spark, d), _WIDE_COLUMNS)


@query("correlation_spearman", f"WITH w AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM w) SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(a, b), 3) AS r FROM r")
def _(spark, d):
    return explore.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman")


_STRONG = f"{_PAIRS}, strong AS (SELECT column_a, column_b, r, CASE WHEN abs(r) >= 0.75 THEN 'STRONG' ELSE 'MODERATE' END AS strength, CASE WHEN r > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS direction FROM pairs WHERE abs(r) >= 0.5)"


@query("correlation_pairs", f"{_STRONG} SELECT * FROM strong")
def _(spark, d):
    return explore.strong_pairs(pairs(spark, d))


@query("insight_correlation", f"{_STRONG} SELECT column_a, column_b, r, CASE WHEN abs(r) >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM strong ORDER BY abs(r) DESC, column_a, column_b LIMIT 3")
def _(spark, d):
    return explore.correlation_insights(pairs(spark, d))


@query("eda_summary", f"WITH {_SCHEMA} SELECT (SELECT count(*) FROM m) AS rows, count(*) AS columns, " + ", ".join(f"count(*) FILTER (inferred_type = '{k.upper()}') AS {k}" for k in ("numerical", "categorical", "datetime", "text", "identifier", "boolean")) + " FROM schema_report")
def _(spark, d):
    df = _messy(spark, d)
    return explore.eda_summary(df, profile.detect_schema(df))


@query("insight_concentration", """WITH v AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT round(skewness(value), 3) AS skewness, round(100 * sum(value) FILTER (r <= greatest(1, floor(n * 0.05))) / sum(value), 1) AS top_share, min(value) AS low FROM v)
SELECT 'value' AS "column", skewness, top_share, CASE WHEN top_share >= 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM s WHERE skewness > 1.5 AND low >= 0""")
def _(spark, d):
    return explore.concentration_insights(table(spark, d, "events"), ["value", "user_id"])


@query("insight_imbalance", f"WITH {_M} SELECT 'repeat_buyer' AS \"column\", 'no' AS dominant, round(100 * count(*) FILTER (repeat_buyer = 'no') / count(*), 1) AS pct FROM m HAVING count(*) FILTER (repeat_buyer = 'no') / count(*) >= 0.75")
def _(spark, d):
    return explore.imbalance_insights(_messy(spark, d), ["repeat_buyer", "status", "channel"])


@query("insight_quality", f"{_SCORE} SELECT overall_score, CASE WHEN overall_score < 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM scored WHERE overall_score < 85")
def _(spark, d):
    return explore.quality_insights(scored(spark, d))


# claims about each pair: every second one is off by 0.3
_CLAIMS = "SELECT concat(column_a, '-', column_b) AS insight_id, 'correlation' AS kind, CASE WHEN length(column_a) % 2 = 0 THEN r ELSE r + 0.3 END AS value FROM "


@query("verify_insights", f"{_PAIRS}, claims AS ({_CLAIMS} pairs) SELECT insight_id, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE abs(claims.value - p.r) <= 0.01) THEN 'VERIFIED' ELSE 'UNSUPPORTED' END AS status FROM claims")
def _(spark, d):
    known = pairs(spark, d)
    none = spark.createDataFrame([], "overall_score double")
    return explore.verify_insights(spark.sql(_CLAIMS + "{known}", known=known), known, none)


_METRICS = "SELECT concat('Total_', o_orderpriority) AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1"
_CLAIMED = "SELECT o_orderstatus AS batch, concat(o_orderstatus, o_orderpriority) AS claim_id, CASE WHEN o_orderstatus = 'F' THEN lower(concat('total_', o_orderpriority)) WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE concat('Total_', o_orderpriority) END AS name, round(avg(o_totalprice), 4) * CASE WHEN o_orderpriority = '1-URGENT' THEN 1.07 WHEN o_orderpriority = '2-HIGH' THEN 1.5 ELSE 1 END AS claimed FROM orders GROUP BY o_orderstatus, o_orderpriority"
_MATCHED = f"""WITH metrics AS ({_METRICS}), claims AS ({_CLAIMED}),
loose AS (SELECT c.batch, c.claim_id, arg_min(m.value, (lower(c.name) <> lower(m.metric), m.metric)) AS v FROM claims c JOIN metrics m ON lower(c.name) = lower(m.metric) OR contains(lower(c.name), lower(m.metric)) OR contains(lower(m.metric), lower(c.name)) GROUP BY 1, 2),
matched AS (SELECT c.batch, c.claim_id, c.name, c.claimed, coalesce(m.value, l.v) AS actual FROM claims c LEFT JOIN metrics m ON m.metric = c.name LEFT JOIN loose l ON l.batch = c.batch AND l.claim_id = c.claim_id)"""
_AUDIT = _MATCHED + """, d AS (SELECT *, round(CASE WHEN actual = 0 THEN abs(claimed) ELSE abs(claimed - actual) / abs(actual) END, 6) AS delta FROM matched),
audited AS (SELECT batch, claim_id, delta, CASE WHEN delta <= 0.03 THEN 'SUPPORTED' WHEN delta <= 0.1 THEN 'PARTIALLY_SUPPORTED' ELSE 'REJECTED' END AS status, CASE WHEN delta IS NULL THEN 0.0 WHEN delta <= 0.03 THEN greatest(0.95, 1 - delta) WHEN delta <= 0.1 THEN 0.7 ELSE 0.2 END AS confidence FROM d)"""


def _matched(spark, d):
    return explore.match_claims(derived(spark, d, _CLAIMED), derived(spark, d, _METRICS))


@query("claim_metric_join", f"{_MATCHED} SELECT batch, claim_id, name, round(claimed, 4) AS claimed, actual FROM matched")
def _(spark, d):
    return _matched(spark, d).withColumn("claimed", F.round("claimed", 4))


@query("audit_claims", f"{_AUDIT} SELECT batch, claim_id, delta, status, CAST(confidence AS DOUBLE) AS confidence FROM audited")
def _(spark, d):
    return explore.audit_claims(_matched(spark, d))


@query("audit_verdict", f"""{_AUDIT}, b AS (SELECT batch, count(*) AS claims, count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'REJECTED') AS rejected, round(avg(confidence), 4) AS confidence FROM audited GROUP BY 1)
SELECT *, CASE WHEN rejected = 0 AND supported / claims >= 0.8 THEN 'PASS' WHEN rejected <= 1 AND supported / claims >= 0.5 THEN 'PASS_WITH_WARNINGS' ELSE 'REJECT' END AS verdict FROM b""")
def _(spark, d):
    return explore.audit_verdicts(explore.audit_claims(_matched(spark, d)))


@query("decision_rules", f"""{_SCORE}, f AS (SELECT arg_min(y, day) AS a, arg_max(y, day) AS b FROM (SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS y FROM events GROUP BY 1)),
o AS (SELECT count(*) FILTER (value > 100) AS total, count(*) FILTER (value > 200) AS high FROM events), l AS (SELECT o_orderstatus AS model, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 'risk_mitigation' AS category, 'validate_ingestion' AS title, 'LOW' AS risk, CAST(0.95 AS DOUBLE) AS confidence, round(overall_score, 4) AS evidence FROM scored WHERE overall_score < 75
UNION ALL SELECT 'model_deployment', concat('deploy_', model), 'MEDIUM', 0.9, score FROM l
UNION ALL SELECT 'operational', CASE WHEN b > a THEN 'plan_for_increasing' ELSE 'plan_for_decreasing' END, 'LOW', 0.88, round(abs((b - a) / (a + 1e-9) * 100), 4) FROM f
UNION ALL SELECT 'risk_mitigation', 'quarantine_anomalies', CASE WHEN high > 0 THEN 'MEDIUM' ELSE 'LOW' END, 0.92, CAST(total AS DOUBLE) FROM o WHERE total > 0""")
def _(spark, d):
    days = derived(spark, d, "SELECT CAST(ts AS DATE) AS day, round(sum(value), 2) AS y FROM events GROUP BY 1")
    forecast = days.agg(F.min_by("y", "day").alias("first"), F.max_by("y", "day").alias("last"))
    anomalies = table(spark, d, "events").agg(F.count_if(F.col("value") > 100).alias("total"), F.count_if(F.col("value") > 200).alias("high"))
    board = derived(spark, d, "SELECT o_orderstatus AS model, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1")
    return explore.decision_rules(scored(spark, d), forecast, anomalies, board)


@query("chart_scatter", "SELECT p_partkey, CAST(p_size AS INTEGER) AS x, p_retailprice AS y FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 100")
def _(spark, d):
    return explore.scatter_sample(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey")


@query("alert_summary", "SELECT s.severity, count(e.event_id) AS alerts FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN (SELECT event_id, CASE WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE event_type = 'error') e USING (severity) GROUP BY 1")
def _(spark, d):
    return explore.alert_summary(derived(spark, d, "SELECT event_id, CASE WHEN value >= 60 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS severity FROM events WHERE event_type = 'error'"))
