"""Which texts contain which words, by an inverted index of character trigrams in place of a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut


def _grams(c: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(none)


def containing(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """``(key, word)`` for every different word of ``words`` and row of ``texts`` whose text contains it, once each.

    A text that contains a word holds all the word's trigrams, so it is met by the one that fewest texts hold,
    and then looked at. Words of one or two characters are grams themselves; the empty word is in every text. Nulls
    match nothing. ``key`` tells rows apart; rows of one key count together. Meant for texts such as names; the index has a
    row for each different gram of a text that some word has.
    """
    asked = words.select(F.col(word).alias("w_")).where("w_ is not null").distinct()
    own = F.when(F.length("w_") >= 3, _grams(F.col("w_"), 3)).otherwise(F.array("w_"))
    grams = asked.select("w_", F.explode(F.array_distinct(own)).alias("gram_"))
    # a file of names is small but makes many grams: its rows go to all tasks, and its grams are cut up once
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select(F.col(key).alias("k_"), F.col(text).alias("t_")).where("t_ is not null").repartition(parts, "k_", "t_")
    every = F.concat(F.array(F.lit("")), *[_grams(F.col("t_"), n) for n in (1, 2, 3)])
    postings = cut(rows.select("k_", F.explode(F.array_distinct(every)).alias("gram_")).join(grams.select("gram_").distinct(), "gram_", "left_semi"))
    held = postings.groupBy("gram_").agg(F.count("*").alias("n_"))
    # a word with a gram that no text holds is in none
    seeds = grams.join(held, "gram_", "left").groupBy("w_").agg(F.min_by("gram_", F.struct("n_", "gram_")).alias("gram_"), F.bool_and(F.col("n_").isNotNull()).alias("all_")).where("all_").drop("all_")
    found = postings.join(seeds, "gram_").select("k_", "w_").distinct()
    sure = found.join(rows, "k_").where(F.contains("t_", F.col("w_"))).select("k_", "w_").distinct()
    return sure.select(F.col("k_").alias(key), F.col("w_").alias(word))
