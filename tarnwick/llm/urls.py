"""URL filters by association rules, with an exact list of host and path rules above them.

Spark's FP-growth mines combinations of URL tokens among the bad rows; those that pass the support, confidence
and chance bounds are rules and block a URL that holds all their tokens. Rules are found by an inverted index
on their rarest token. A rule that holds another rule blocks nothing more, so only the least rules are kept. A
rule has at most three tokens (a parameter); all such rules are found, however long the URLs (see :func:`mine`).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Exact rules up to which each is a branch of one expression; more are joined by host.
MOST_LISTED = 1000
#: Tokens of a block; a basket for FP-growth is as many blocks as a rule has tokens at most.
BLOCK = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens in order: scheme, host labels, path words (numbers and their endings apart) and query keys; a null or empty URL has none."""
    host, path = host_of(url), path_of(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x))
    words = F.transform(F.regexp_extract_all(F.lower(path), F.lit(r"([\p{L}][\p{L}\p{N}_-]*)"), F.lit(1)), lambda x: F.concat(F.lit("path="), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")), F.lit(r"([^&=]+)=?[^&]*"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))))
    all_of = F.array_sort(F.array_distinct(F.concat(scheme, labels, words, keys)))
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.filter(all_of, lambda x: ~x.endswith("=")))


def _rates(sets: DataFrame, all_rows: int, all_bad: int, min_support: float, min_confidence: float, chance: float | None = None, tokens: int = 1) -> DataFrame:
    """``(antecedent, n, bad)`` with confidence, lift and support, and whether it is a rule.

    With ``chance``, the bad rows of a rule must be so many that with labels dealt out at random no set of tokens would
    have as many, but for that chance. By Chernoff's bound n times the divergence of its confidence from the share of all
    rows must reach the logarithm of the sets of its size over ``chance`` / 2 to the power of its size; there are as
    many as ways to choose from ``tokens``, the number of those that enough rows hold.
    """
    confidence = F.col("bad") / F.col("n")
    usual = all_bad / max(all_rows, 1)
    lift = confidence / (usual or 1.0)
    is_rule = (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("lift") > 1)
    if chance is not None and 0 < usual < 1:
        c, size = F.col("confidence"), F.size("antecedent")
        apart = c * F.log(c / usual) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - usual))).otherwise(0.0)
        is_rule &= F.coalesce(F.col("n") * apart, F.lit(0.0)) >= size * float(np.log(2 * max(tokens, 1))) - F.log(F.factorial(F.least(size, F.lit(20)))) - float(np.log(chance))
    return sets.select("antecedent", "n", "bad", confidence.alias("confidence"), lift.alias("lift"), (F.col("bad") / max(all_rows, 1)).alias("support")).withColumn("is_rule", is_rule)


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_count: int = 1, chance: float | None = None, longest: int = 3) -> DataFrame:
    """``(antecedent array<string>, confidence, lift, support)`` from ``(tokens array<string>, bad boolean)``: the least rules of up to ``longest`` tokens, all of them.

    A rule's tokens and the bad label stand together in the share ``min_support`` of the rows and in ``min_count``
    rows, and of the rows with its tokens the share ``min_confidence`` is bad, more than of all rows. A rule that
    holds all tokens of another is left out. Single tokens are counted. Combinations of those that are no rules by
    themselves come from FP-growth over the bad rows (see :func:`_baskets`), and are then counted over whole
    rows, good ones too. Tokens of the same rows are one item, so templates do not multiply: a pair is listed with
    each of them, a longer rule asks for all of them. Rows with a null label don't count. No rows: no rules.

    ``chance`` bounds the chance of finding any rule where labels tell nothing. It also tells how many bad rows a set
    of tokens needs to be looked at, whatever the table's size.
    """
    rows = cut(labelled.where("bad is not null").select("tokens", F.col("bad").cast("int").alias("bad")))
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    told = np.log(total / bad) if chance is not None and 0 < bad < total else None  # what one bad row tells at most
    if told:
        min_count = max(min_count, int(np.ceil(np.log(2 / chance) / told)))
    least = max(min_support, min_count / max(total, 1))
    tally = [F.count("*").alias("n"), F.sum("bad").alias("bad")]
    counted = cut(rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(*tally))
    held_by_enough = counted.where(F.col("n") >= min_count).count()
    rates = lambda sets: _rates(sets, total, bad, least, min_confidence, chance, held_by_enough)
    ones = cut(rates(counted.where((F.col("bad") >= max(min_count, 1)) & (F.col("bad") / max(total, 1) >= least)).select(F.array("token").alias("antecedent"), "n", "bad")))
    need = max(1, int(np.ceil(least * total - 1e-6)))
    if told:  # two tokens must tell more than one
        need = max(need, int(np.ceil((2 * np.log(2 * max(held_by_enough, 1)) - np.log(2) - np.log(chance)) / told - 1e-6)))
    open_ = ones.where(~F.col("is_rule") & (F.col("bad") >= need)).select(F.col("antecedent")[0].alias("token"))
    numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    held = cut(numbered.select("row", "bad", F.explode("tokens").alias("token")).join(open_, "token"))
    same = held.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("i"))
    same = same.groupBy("n", "h", "i").agg(F.array_sort(F.collect_list("token")).alias("group")).select(F.col("group")[0].alias("token"), "group")
    lead = cut(same)
    items = cut(held.join(lead.select("token"), "token", "left_semi").groupBy("row").agg(F.first("bad").alias("bad"), F.array_sort(F.collect_list("token")).alias("u")))
    baskets, need = _baskets(items.where("bad = 1").select("u"), need, longest)
    baskets = cut(baskets)
    n_baskets = baskets.count()
    rules = ones.where("is_rule")
    if n_baskets:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / n_baskets)).fit(baskets)
        found = cut(model.freqItemsets.where(F.size("items").between(2, longest)).select(F.array_sort("items").alias("antecedent")))
        exact = _least(cut(rates(_support(found, items.groupBy("u").agg(*tally))).where("is_rule")))
        whole = exact.withColumn("lead", F.explode("antecedent")).join(lead.withColumnRenamed("token", "lead"), "lead").groupBy("antecedent").agg(F.collect_list("group").alias("g"))
        each = F.flatten(F.transform(F.col("g")[0], lambda x: F.transform(F.col("g")[1], lambda y: F.array(x, y))))
        spelt = F.when(F.size("g") == 2, each).otherwise(F.array(F.flatten("g")))
        rules = rules.unionByName(exact.join(whole, "antecedent").withColumn("antecedent", F.explode(spelt)).withColumn("antecedent", F.array_sort("antecedent")).select(*rules.columns))
    return cut(rules.select("antecedent", "confidence", "lift", "support"))


def _baskets(rows: DataFrame, need: int, longest: int) -> tuple[DataFrame, int]:
    """Baskets ``(items)`` of few tokens that stand for the ``rows(u)``, and in how many of them a set must stand.

    Each set of up to ``longest`` tokens that ``need`` rows hold stands in as many baskets as the second result says. A
    row's tokens are cut into blocks of :data:`BLOCK`, and each choice of ``longest`` blocks is a basket, so a set of a
    row's tokens is in one of its baskets at least, and FP-growth lists 2 to the power of a small number of sets a basket
    where it would not end on whole rows of 40 tokens. As a set is in ``need`` rows, it is in half of these at least
    whatever the other half are: the widest rows, up to ``need`` / 2 of them, need no baskets, so a few rows of
    thousands of tokens cost nothing here.
    """
    one = BLOCK * longest
    apart = 0
    widths = rows.where(F.size("u") > one).groupBy(F.size("u").alias("w")).count().orderBy(F.desc("w")).collect()  # one row a width
    widest = max([one, *(r["w"] for r in widths)])
    for r in widths:
        if apart + r["count"] > need // 2:
            break
        apart += r["count"]
        widest = r["w"] - 1
    few = rows.where(F.size("u") <= one).select(F.col("u").alias("items"))
    many = rows.where((F.size("u") > one) & (F.size("u") <= widest)).select("u", F.ceil(F.size("u") / BLOCK).cast("int").alias("blocks"), F.array().cast("array<int>").alias("at"))
    for left in reversed(range(longest)):
        after = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0)) + 1
        many = many.withColumn("next", F.explode(F.sequence(after, F.col("blocks") - left))).withColumn("at", F.concat("at", F.array("next"))).drop("next")
    many = many.select(F.flatten(F.transform("at", lambda i: F.slice("u", (i - 1) * BLOCK + 1, BLOCK))).alias("items"))
    return few.unionByName(many), need - apart


def _support(found: DataFrame, sets: DataFrame) -> DataFrame:
    """``(antecedent, n, bad)``: the sums of ``sets(u, n, bad)`` with all tokens of each of ``found(antecedent)``, which stand in an index under the token that the fewest sets hold."""
    counts = sets.select(F.explode("u").alias("token")).groupBy("token").agg(F.count("*").alias("k"))
    index = found.select("antecedent", F.explode("antecedent").alias("token")).join(counts, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("k", "token")).alias("token"))
    full = sets.withColumn("token", F.explode("u")).join(index, "token").where(F.size(F.array_except("antecedent", "u")) == 0)
    return full.groupBy("antecedent").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _least(rules: DataFrame) -> DataFrame:
    """The rules that hold no other rule, found by the first token of the other."""
    rules = rules.dropDuplicates(["antecedent"])
    other = rules.select(F.col("antecedent")[0].alias("token"), F.col("antecedent").alias("part"))
    inside = rules.select("antecedent", F.explode("antecedent").alias("token")).join(other, "token").where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return rules.join(inside.select("antecedent").distinct(), "antecedent", "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, n_rules, confidence)`` for the distinct token sets of ``sets(tokens)`` that hold all tokens of a rule: how many rules, and the best one's confidence.

    Each rule stands in the index under the token of its own that the fewest sets hold.
    """
    posting = sets.select("tokens", F.explode("tokens").alias("token"))
    numbered = rules.select(F.xxhash64("antecedent").alias("rule"), "antecedent", "confidence")
    wanted = numbered.select("rule", F.explode("antecedent").alias("token"))
    counts = posting.groupBy("token").agg(F.count("*").alias("n"))
    key = wanted.join(counts, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = numbered.join(key, "rule").select("token", "antecedent", "confidence")
    found = posting.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return found.groupBy("tokens").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (host, path, verdict) that fits, as ``host + path``, and its verdict; null if none does. A rule fits its host and all subdomains if the path starts with its own."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last branch put in front wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def listed_by_join(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows(host, path, ...)`` with ``rule`` and ``verdict`` as :func:`listed` gives them, for lists of any length: the ends of each host meet the rules of that host."""
    table = rows.sparkSession.createDataFrame([(h, p, v) for h, p, v in rules], "suffix string, start string, v string")
    names = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    sites = rows.where("host is not null and path is not null").select("host", "path").distinct()
    found = sites.select("host", "path", F.explode(ends).alias("suffix")).join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    text = F.concat("suffix", "start")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), F.col("suffix"), F.col("start"), F.col("v"), text.alias("rule"))).alias("b"))
    return rows.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("verdict")), ["host", "path"], "left")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], min_support: float = 0.002, min_confidence: float = 0.5, key: str = "page_id", url: str = "url", chance: float = 0.05, longest: int = 3) -> DataFrame:
    """``(key, host, path, rule, verdict, n_rules, confidence)`` for every row of ``pages``.

    ``labelled`` has ``(url, bad boolean)``. ``verdict`` is the listed rule's, else ``block`` if a mined rule
    matches (``n_rules`` of them, the best with ``confidence``; see :func:`mine`), else ``allow``. A null URL, or one without
    ``://``, has empty host and path. Repeated rows are each judged; URLs of any length are read whole; other
    columns are left out.
    """
    mined = mine(labelled.select(tokens_of(F.col("url").cast("string")).alias("tokens"), F.col("bad").cast("boolean").alias("bad")), min_support, min_confidence, chance=chance, longest=longest)
    at = F.col(url).cast("string")
    rows = pages.select(F.col(key).alias("k"), host_of(at).alias("host"), path_of(at).alias("path"), tokens_of(at).alias("tokens"))
    if len(rules) > MOST_LISTED:
        rows = listed_by_join(rows, rules)
    else:
        rule, verdict = listed(F.col("host"), F.col("path"), rules)
        rows = rows.withColumns({"rule": rule, "verdict": verdict})
    hits = match(rows.select("tokens").distinct(), mined)
    return rows.join(hits, "tokens", "left").select(
        F.col("k").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
        "confidence",
    )
