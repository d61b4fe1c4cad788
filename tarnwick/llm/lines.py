"""Line dedup: lines that many documents share go from all of them but one.

Every line is brought to a key (white space at both ends off, A-Z lower-cased), the key to a 128-bit hash.
Documents are counted for each hash, lines of a hash that enough documents hold are dropped by their
position, and what is left is put together again by position. Only hashes and positions are counted and
joined; a text moves once, to the positions it loses.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, join_by_count, row_key

#: What counts as white space at the ends of a line: blank and the bytes 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without :data:`BLANKS` at both ends and with A-Z, no other letters, lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def without_repeated_lines(docs: DataFrame, least: int = 3, shortest: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, kept, n_lines, n_dropped)`` for each row of ``docs``: the whole text without the lines that others repeat.

    A text is cut at ``\\n``. A key of ``shortest`` code points or more that ``least`` different documents hold loses
    all its lines, but for those of the document with the largest ``key``, which keeps them all. A null or empty text
    is one empty line. Rows of one ``key`` are one document, though each row's text is judged and kept by itself;
    rows without a key are documents by their texts, and come before all others in the order of keys. ``key`` is a
    whole number. No rows: none. Other columns are left out.

    A key that a third of all lines hold is counted before it is shuffled and joined by a broadcast.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), row_key(F.col(key), t).alias("r"), t.alias("t"))
    split = F.split("t", "\n")
    who = F.struct(F.col("k").isNotNull().alias("has"), F.coalesce(F.col("k").cast("long"), F.col("r")).alias("id"))
    long_enough = rows.select("r", who.alias("who"), F.posexplode(split).alias("at", "line")).where(F.length("line") >= shortest)
    keyed = long_enough.select("r", "who", "at", line_key(F.col("line")).alias("line")).where(F.length("line") >= shortest)
    lines = cut(keyed.select("r", "who", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    holders = lines.groupBy("h1", "h2", "who").agg(F.count("*").alias("times"))
    found = cut(holders.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.sum("times").alias("times"), F.max("who").alias("last")).where(F.col("n") >= least))
    lost = join_by_count(lines, found, ["h1", "h2"], "times").where("who < last").select("r", "at").distinct()
    lost = lost.groupBy("r").agg(F.collect_list("at").alias("lost"))
    places = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.when(F.col("lost").isNull(), F.col("t")).otherwise(
        # the lines are a variable here, so that they are cut once for all positions
        F.transform(F.array(split), lambda own: F.array_join(F.transform(F.array_except(places, "lost"), lambda i: F.get(own, i)), "\n"))[0]
    )
    out = rows.join(lost, "r", "left").select(F.col("k").alias(key), kept.alias("kept"), F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))
    return out
