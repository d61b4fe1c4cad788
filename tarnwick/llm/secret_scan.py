"""Secret scans: pattern candidates over whole texts, false positives removed by a random forest.

All on the main path are DataFrame functions and Spark ML. A candidate's features are its length, shares and
transitions of character classes, dictionary coverage, its text's path and the words next to it; the forest
is trained from labelled findings, on a hashed sample whose expected size is a parameter. Where nobody has
labelled any, :func:`planted` makes some whose labels are known by how they were made, not by how they look.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, free_name, row_key

#: Words before a value that is to be kept secret.
_KEYWORD = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)"
_RUN = r"A-Za-z0-9+/_-"
#: The keyword may stand anywhere in the name: DB_PASSWORD, client_secret, secret_key. Words before no : or = fail at once.
_ASSIGNED = rf"(?<![{_RUN}])(?=[{_RUN}]*+[\"']?\s{{0,3}}[:=])[{_RUN}]*(?i:{_KEYWORD})[A-Za-z0-9_-]*+[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?"
#: The user before a password in a URL.
_LOGIN = r"//[^\s/:@?#\"']*:(?=[^\s/?#\"']+@)"
_HEAD = rf"(?:{_LOGIN}|{_ASSIGNED})"
_HEAD_OF_MATCH = rf"(?:{_LOGIN.split('(?=')[0]}|{_ASSIGNED})"
_KEY_END = r"(?:[A-Za-z0-9+/=\s:,.\\]*+(?:-(?!----END)[A-Za-z0-9+/=\s:,.\\]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?+"
#: A URL's password, an assigned value, a private key (its head if it has no end), or a run of 12 or more letters, digits and joining signs.
CANDIDATE = rf"{_LOGIN}[^\s/?#\"']+(?=@)|{_ASSIGNED}[^\s\"',;]+|-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----{_KEY_END}|[{_RUN}]{{12,}}={{0,2}}"
#: Secrets of fewer characters are replaced only behind their name or user, as they may be parts of other words.
SHORT = 6
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ALL = _LOWER.upper() + _LOWER + "0123456789"
FEATURES = ["length", "transitions", "digits", "uppers", "vowels", "alternations", "distinct", "hex", "coverage", "assigned_", "keyword_near", "quoted", "words_before", "words_after", "path_depth", "code_path", "test_path"]
_CUT = "\u0001"


def findings(docs: DataFrame, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """``(row, key, path, token, assigned, before, after)``: the candidates of every whole text, each with the up to 24 characters before and 12 after it; equal ones of a text once.

    Assigned values and URLs' passwords of any length, private keys, and runs with a letter or digit that are
    not one letter repeated. ``row`` stands for the pair of key and text, null ones too. A null or empty text
    has none; a null path stays null.
    """
    parts = F.col("parts")
    # odd places hold candidates, even ones what stands between them
    rows = docs.select(F.col(key).alias("k"), F.col(path).cast("string").alias("p"), F.col(text).cast("string").alias("t"))
    rows = rows.select(row_key(F.col("k"), F.col("t")).alias("row"), "k", "p", F.split(F.regexp_replace(F.translate("t", _CUT, " "), CANDIDATE, f"{_CUT}$0{_CUT}"), _CUT).alias("parts"))

    def one(i: Column) -> Column:
        m = parts[2 * i + 1]
        token = F.regexp_replace(m, rf"^{_HEAD_OF_MATCH}", "")
        head = F.length(m) - F.length(token)
        before = F.concat(F.when(i > 0, F.right(parts[F.greatest(2 * i - 1, F.lit(0))], F.lit(24))).otherwise(F.lit("")), F.right(parts[2 * i], F.lit(24)))
        after = F.concat(F.left(parts[2 * i + 2], F.lit(12)), F.when(2 * i + 3 < F.size(parts), F.left(parts[F.least(2 * i + 3, F.size(parts) - 1)], F.lit(12))).otherwise(F.lit("")))
        return F.struct(token.alias("token"), (head > 0).alias("assigned"), F.concat(F.right(before, F.lit(24)), F.substring(m, F.lit(1), head)).alias("before"), F.left(after, F.lit(12)).alias("after"))

    places = F.filter(F.sequence(F.lit(0), F.expr("size(parts) div 2 - 1")), lambda i: parts[2 * i + 1].rlike("[A-Za-z0-9]") & ~parts[2 * i + 1].rlike(r"^([A-Za-z])\1*$"))
    # outer, since a filter on the array would be pushed below it and search the text again
    found = rows.select("row", "k", "p", F.explode_outer(F.when(F.size(parts) > 1, F.array_distinct(F.transform(places, one)))).alias("f")).where("f is not null")
    return found.select("row", F.col("k").alias(key), F.col("p").alias("path"), "f.*")


def features(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``found`` with a column for each of :data:`FEATURES`; it is read twice. ``dictionary`` has ``(word)``; coverage is the share of a token's characters in runs of three or more letters that are words."""
    token = F.col("token")
    runs = found.select("token").distinct().select("token", F.explode(F.regexp_extract_all(F.lower("token"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word"))
    words = dictionary.select(F.lower("word").alias("word")).where("word is not null").distinct()
    covered = runs.join(words, "word").groupBy("token").agg(F.sum(F.length("word")).alias("covered"))
    n = F.greatest(F.length(token), F.lit(1))
    share = lambda kept: F.length(F.regexp_replace(token, kept, "")) / n
    kinds = F.translate(token, _ALL, "A" * 26 + "a" * 26 + "9" * 10)
    kinds = F.regexp_replace(kinds, "[^Aa9]", "-")
    sounds = F.regexp_replace(F.regexp_replace(F.lower(token), "[aeiou]", "0"), "[a-z]", "1")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    out = found.join(covered, "token", "left")
    return out.select(
        *found.columns,
        F.length(token).cast("double").alias("length"),
        ((F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n).alias("transitions"),
        share("[^0-9]").alias("digits"),
        share("[^A-Z]").alias("uppers"),
        share("(?i)[^aeiou]").alias("vowels"),
        ((F.length(F.regexp_replace(sounds, r"(.)\1+", "$1")) - 1) / n).alias("alternations"),
        (F.size(F.array_distinct(F.split(token, ""))) / n).alias("distinct"),
        flag(token.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
        flag(F.col("assigned")).alias("assigned_"),
        flag(F.col("before").rlike(rf"(?i){_KEYWORD}")).alias("keyword_near"),
        flag(F.col("before").rlike("[\"']$")).alias("quoted"),
        F.regexp_count("before", F.lit(r"\p{L}{2,}")).alias("words_before"),
        F.regexp_count("after", F.lit(r"\p{L}{2,}")).alias("words_after"),
        F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).alias("path_depth"),
        flag(F.col("path").rlike(r"(?i)\.(?:env|ya?ml|json|toml|ini|cfg|conf|properties|py|js|ts|java|go|rb|sh|tf)$")).alias("code_path"),
        flag(F.col("path").rlike("(?i)test|example|sample|fixture|mock")).alias("test_path"),
    )


def planted(docs: DataFrame, sample: int = 8000, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """``(key, text, path, value, label)``: about ``sample`` pieces of texts of ``docs``, chosen by a hash, each with one value put into it whose label is known. A text gives several if there are few, 64 at most.

    Half the values are secrets (label 1.0): digits of a hash in hexadecimal, base64 or capitals, with and without
    an issuer's beginning, or short with signs. The others (0.0) are words and pairs of words of the text itself,
    numbers, dates, versions, paths, and what people write in place of a secret. Both stand in the same
    surroundings, in prose and behind names, so that these do not tell them apart. Null texts are left out.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(path).cast("string").alias("p"), F.col(text).cast("string").alias("t")).where("t is not null")
    n = rows.count()
    pick = lambda salt, m: F.pmod(F.xxhash64("k", "t", "i", F.lit(salt)), F.lit(m)).cast("int")
    times = min(64, -(-sample // max(n, 1)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times)))).where(F.pmod(F.xxhash64("k", "t", "i", F.lit("sample")), F.lit(1 << 40)) / (1 << 40) < min(1.0, sample / max(n * times, 1)))
    hexa = F.sha2(F.concat_ws(" ", "k", "i", "t"), 512)
    b64 = F.base64(F.unhex("h"))
    letters = F.regexp_replace(b64, "[+/=]", "")
    capitals = F.translate(F.upper("h"), "01", "GH")
    word = lambda i: F.coalesce(F.get("w", pick(i, 1 << 20) % F.greatest(F.size("w"), F.lit(1))), F.lit("value"))
    number = F.conv(F.substring("h", 1, 13), 16, 10)
    secrets = [F.substring("h", 1, 32), F.substring("h", 1, 40), F.substring("h", 1, 64), F.left(b64, F.lit(40)), F.left(letters, F.lit(24)), F.concat(F.lit("AKIA"), F.left(capitals, F.lit(16))), F.concat(F.lit("ghp_"), F.left(letters, F.lit(36))), F.concat(F.left(letters, F.lit(6)), F.lit("!"), F.substring(letters, 9, 4))]
    plain = [word("a"), F.concat(word("a"), F.lit("-"), word("b")), F.concat(word("a"), F.lit("_"), word("b"), F.lit("_"), word("c")), F.concat(word("a"), F.initcap(word("b")), F.initcap(word("c"))), F.lpad(number, 16, "4"), F.concat(F.lit("20"), F.substring(number, 1, 2), F.lit("-0"), F.substring(number, 3, 1), F.lit("-1"), F.substring(number, 4, 1)), F.concat(F.lit("/usr/share/"), word("a"), F.lit("/"), word("b")), F.element_at(F.array(*map(F.lit, ("changeme", "your_token_here", "placeholder", "REPLACE_ME", "xxxxxxxxxxxx", "not-available", "undefined", "required"))), pick("p", 8) + 1)]
    around = [("password=", ""), ("token = \"", "\""), ("api_key: ", ","), ("AWS_SECRET_ACCESS_KEY=", ""), ("see https://user:", "@host.example/"), ("", ""), ("(", ")"), ("id ", ".")]
    choose = lambda values, salt: F.element_at(F.array(*values), pick(salt, len(values)) + 1)
    at = 1 + pick("at", 1 << 30) % F.greatest(F.length("t") - 100, F.lit(1))
    made = rows.select("k", "t", "i", "p", F.substring("t", at, F.lit(60)).alias("left"), F.substring("t", at + 60, F.lit(40)).alias("right"), hexa.alias("h"), F.regexp_extract_all(F.substring("t", at, F.lit(400)), F.lit(r"(\p{L}{3,})"), F.lit(1)).alias("w"))
    made = made.select("k", "p", "left", "right", pick("label", 2).cast("double").alias("label"), F.when(pick("label", 2) == 1, choose(secrets, "kind")).otherwise(choose(plain, "kind")).alias("value"), choose([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around], "around").alias("x"))
    return made.select(F.col("k").alias(key), F.concat("left", F.lit(" "), "x.a", "value", "x.b", F.lit(" "), "right").alias("text"), F.col("p").alias("path"), "value", "label")


def labelled(docs: DataFrame, dictionary: DataFrame, sample: int = 8000, text: str = "text", path: str = "source", key: str = "doc_id") -> DataFrame:
    """Findings with :data:`FEATURES` and ``label`` in the texts of :func:`planted`; those that are not the value put in have no label and are left out."""
    made = cut(planted(docs, sample, text, path, key))
    found = findings(made.withColumn("k_", F.struct("value", "label")), "text", "path", "k_")
    return features(cut(found.select("path", "token", "assigned", "before", "after", "k_.value", "k_.label").where(F.col("token") == F.col("value"))), dictionary)


def _vector() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | float | None:
    """A forest from findings with :data:`FEATURES` and ``label`` (0 or 1), an equal share of about ``sample`` rows for each label; the label itself if there is only one, None without any."""
    rows = labelled.where("label is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), None)
    level = F.pmod(F.xxhash64("token", "before", "after"), F.lit(1 << 40)) / (1 << 40)
    chosen = F.coalesce(*(F.when(F.col("label") == v, level < min(1.0, sample / 2 / n)) for v, n in counts.items()))
    ordered = _vector().transform(rows.where(chosen)).select("token", "before", "features", "label").repartition(1).sortWithinPartitions("token", "before", "label").select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(ordered)


def judge(found: DataFrame, model: RandomForestClassificationModel | float | None, least: float = 0.5) -> DataFrame:
    """``found`` with ``score`` and ``is_secret`` (score of ``least`` or more). Without a model nothing is known to be false: score null, every finding stays."""
    if isinstance(model, RandomForestClassificationModel):
        scored = model.transform(_vector().transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("score", F.lit(model).cast("double"))
    return scored.withColumn("is_secret", F.coalesce(F.col("score") >= least, F.lit(True)))


def scan(docs: DataFrame, dictionary: DataFrame, known: DataFrame | None = None, text: str = "text", path: str = "source", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """``(row, key, path, token, assigned, before, after, score, is_secret)`` for the candidates of every text, as :func:`findings` gives them.

    ``known`` holds findings with features and ``label``; without it those of :func:`labelled` are used. Texts
    are searched once, whole and however long. Repeated rows give repeated findings; other columns are left
    out. No texts: no rows.
    """
    found = features(cut(findings(docs, text, path, key)), dictionary)
    model = train(labelled(docs, dictionary, text=text, path=path, key=key) if known is None else known)
    return judge(found, model, least).select("row", key, "path", "token", "assigned", "before", "after", "score", "is_secret")


def redact(docs: DataFrame, scanned: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every occurrence of its secrets replaced by ``mark``, the longest first; all columns and rows stay. Secrets under :data:`SHORT` characters are replaced behind a keyword or in a URL only.

    Findings belong to a row by its key and text together, so null and repeated keys are redacted too.
    """
    mine, secrets = free_name(docs, "row"), free_name(docs, "secrets")
    held = scanned.where("is_secret").groupBy(F.col("row").alias(mine)).agg(F.collect_set("token").alias(secrets))
    held = held.withColumn(secrets, F.transform(F.array_sort(F.transform(secrets, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: x["x"]))
    literal = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    behind = lambda x: F.concat(F.lit(f"({_HEAD})"), literal(x), F.lit("(?=[\\s\"',;@]|$)"))
    shown = "$1" + mark.replace("\\", "\\\\").replace("$", "\\$")
    hide = lambda acc, x: F.when(F.length(x) < SHORT, F.regexp_replace(acc, behind(x), F.lit(shown))).otherwise(F.replace(acc, x, F.lit(mark)))
    rows = docs.withColumn(mine, row_key(F.col(key), F.col(text).cast("string"))).join(held, mine, "left")
    new = F.when(F.col(secrets).isNull(), F.col(text)).otherwise(F.aggregate(secrets, F.col(text), hide))
    return rows.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
