"""Column helpers: missing values, coercion, vectors and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATS = (T.FloatType, T.DoubleType)
#: Words that are no search terms.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
#: What a word looks like that is a search term.
TOKEN = "^[a-z0-9_-]{2,}$"
#: Name patterns of identifier columns.
ID_NAMES = [r"^id$", r"_id$", r"^id_", "customer_id", "user_id", "order_id", "transaction_id", "uuid", "guid", "email", "phone", "ssn", "passport", "account_number"]
#: Texts that start like dates.
DATES = [r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\d{2}/\d{4}", r"^\d{4}/\d{2}/\d{2}"]
#: Texts that stand for truth values.
TRUTHS = ["0", "1", "true", "false", "yes", "no", "t", "f", "y", "n"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, so that missing is one thing."""
    fix = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, FLOATS)}
    return df.withColumns(fix) if fix else df


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def coerce_numeric(c: Column) -> Column:
    """The number that a text stands for, else NULL."""
    return c.try_cast("double")


def coerce_timestamp(df: DataFrame, column: str, to: str = "ts") -> DataFrame:
    """``to``: the time a column stands for. Texts are parsed; numbers are epoch milliseconds or seconds by the size of their median; the unreadable is NULL."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return df.withColumn(to, F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd"))))
    if isinstance(kind, T.NumericType):
        middle = df.agg(F.percentile_approx(c, 0.5, 1000).alias("middle_"))
        ms, s = F.timestamp_millis(c.cast("long")), F.timestamp_seconds(c.cast("double"))
        return df.crossJoin(F.broadcast(middle)).withColumn(to, F.when(F.col("middle_") > 9e10, ms).when(F.col("middle_") > 9e7, s)).drop("middle_")
    return df.withColumn(to, c.cast("timestamp"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a length is under 1e-6."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    la, lb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((la < 1e-6) | (lb < 1e-6), 0.0).otherwise(dot(a, b) / (la * lb))


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, ``_`` and ``-``, from which :func:`tokens` come."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_-]+")


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more letters, digits, ``_`` or ``-`` that are no stop words, in order."""
    parts = F.transform(words(text), lambda w: F.trim(w, F.lit("-")))
    return F.filter(parts, lambda w: w.rlike(TOKEN) & ~w.isin(STOP_WORDS))


def any_match(name: str, patterns: list[str]) -> bool:
    import re

    return any(re.search(p, name, re.I) for p in patterns)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over the rows where both are there; NULL where one of them doesn't vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def tidy(c: Column) -> Column:
    """Four decimals; none from a million on, where they would be noise of the summing order."""
    return F.when(F.abs(c) >= 1e6, F.round(c, 0)).otherwise(F.round(c, 4))
