"""Secret scan: candidates by shape, judged by a random forest, in DataFrame operations only.

The forest is trained by Spark ML on labelled findings and then written out as one SQL expression, so that scoring a
corpus is a projection: no shuffle, no Python.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Frequent parts of words of four languages, for dictionary coverage.
WORD_PARTS = [
    "tion", "ment", "ing", "and", "the", "ent", "ion", "her", "for", "that", "this", "with", "from", "have", "able", "ness", "less", "ung", "heit", "keit", "lich", "schaft", "sch", "ein", "ver", "ber", "und",
    "der", "die", "das", "eau", "elle", "ier", "que", "oir", "aux", "ción", "mente", "ado", "osa", "ara", "los", "est", "ist", "ter", "ate", "ive", "ous", "pro", "con", "pre", "inter", "file", "data", "name",
    "test", "user", "page", "image", "link", "index", "home", "example", "your", "here", "password", "secret", "token", "value", "string", "default", "config", "public", "class", "function", "return",
]

# Words near a candidate that speak for and against a secret.
FOR_WORDS = r"pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|private|credential|bearer|auth"
AGAINST_WORDS = r"sha\d*|md5|commit|checksum|digest|uuid|guid|revision|etag|example|placeholder|dummy|sample|integrity|href|src|url"

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
MIN_SCORE = 0.5

FEATURES = ["length", "digit_share", "upper_share", "letter_digit", "case_change", "vowel_pairs", "distinct_share", "coverage", "hex", "path", "for_before", "against_before", "for_itself", "against_itself", "assigned", "quoted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (number of the white-space word), word, before, after, run (its number within the word), value: each run of key characters."""
    words = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"\s+").alias("words"))
    near = lambda i, by: F.coalesce(F.get("words", i + by), F.lit(""))
    # neighbours are taken before the candidates become rows, so that no row carries its whole text
    one = lambda w, i: F.when(w.rlike(CANDIDATE), F.struct(i.alias("place"), w.alias("word"), F.concat_ws(" ", near(i, -3), near(i, -2), near(i, -1)).alias("before"), near(i, 1).alias("after")))
    found = F.filter(F.transform("words", one), lambda x: x.isNotNull())
    # the outer form keeps Spark from finding all candidates twice, to filter texts without any
    return with_value(words.select("doc_id", F.explode_outer(found).alias("c")).where("c IS NOT NULL").select("doc_id", "c.*"))


def with_value(found: DataFrame) -> DataFrame:
    """A row for each run of key characters of the word, without a name and an equals sign or colon that the word or a later run begins with."""
    tail = F.regexp_replace("word", r"^[\"'(]*[A-Za-z][A-Za-z0-9_.-]{0,30}[=:]+(?=[\"']?[A-Za-z0-9+/_=-]{16})", "")
    # a later run may hold a name of its own, as in a query string
    own = lambda v, i: F.when(i == 0, v).otherwise(F.regexp_replace(v, r"^[A-Za-z][A-Za-z0-9_-]{0,30}=+(?=[A-Za-z0-9+/_=-]{16})", ""))
    return found.select("*", F.posexplode(F.transform(F.regexp_extract_all(tail, F.lit(f"({CANDIDATE})"), 1), own)).alias("run", "value"))


def with_features(found: DataFrame) -> DataFrame:
    value, size = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    count = lambda c, pattern: F.regexp_count(F.lower(c), F.lit(pattern)).cast("double")
    flag = lambda c: c.cast("double")
    left = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(WORD_PARTS, key=len, reverse=True)), ""))
    computed = {
        "length": size.cast("double"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        # transitions: looked at from each first character, so that none is skipped
        "letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "case_change": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_pairs": share("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxz])|[bcdfghjklmnpqrstvwxz](?=[aeiou])"),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(62)),
        "coverage": 1 - left / size,
        "hex": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "path": count(F.col("word"), r"/|\.(com|org|net|html?|png|jpe?g|js|css|py|txt)\b"),
        "for_before": count(F.col("before"), FOR_WORDS),
        "against_before": count(F.col("before"), AGAINST_WORDS),
        "for_itself": count(F.col("word"), FOR_WORDS + "|^[\"']?(akia|ghp_|sk_live_|xoxb-|eyj)"),
        "against_itself": count(F.col("word"), AGAINST_WORDS + "|x{4,}|0{6,}|1234|abcd"),
        "assigned": flag(F.concat_ws(" ", "before", "word").rlike(r"[=:]\s*[\"']?[A-Za-z0-9+/_-]{16,}")),
        "quoted": flag(F.col("word").rlike("[\"'][A-Za-z0-9+/_=-]{16,}[\"']")),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in computed.items()})


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 5) -> DataFrame:
    """before, word, after, label: findings made by rule from a seed, half of them secrets. A reviewed set may stand in its place."""
    draw = random.Random(seed)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    lower, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mixed_case = lower + lower.upper() + digits
    prose = lambda: "".join(draw.choice(WORD_PARTS[:56]) for _ in range(draw.randint(1, 2)))
    long_word = lambda: "".join(draw.choice(WORD_PARTS[:56]) for _ in range(draw.randint(4, 9)))
    unknown_word = lambda: "".join(pick("bcdfghlmnprstw", draw.randint(1, 2)) + pick("aeiou", draw.randint(1, 2)) for _ in range(draw.randint(6, 9)))
    name = lambda: draw.choice(["password", "token", "secret", "api_key", "auth_token", "access_key", "passwd", "credentials"])
    secret = [
        lambda: ("", "AKIA" + pick(lower.upper() + "234567", 16)),
        lambda: ("", f"{name()}={pick(hexa, draw.choice([16, 18, 24, 32]))}"),
        lambda: (f"{name()} =", f'"{pick(hexa, draw.choice([32, 40, 64]))}"'),
        lambda: (f"{name()}:", pick(mixed_case + "+/", draw.choice([20, 32, 40]))),
        lambda: (f"{name()} is", pick(mixed_case, draw.choice([20, 24, 32]))),
        lambda: ("", draw.choice(["ghp_", "sk_live_", "xoxb-"]) + pick(mixed_case, draw.choice([24, 36]))),
        lambda: ("Authorization: Bearer", "eyJ" + pick(mixed_case + "_-", 48)),
    ]
    harmless = [
        lambda: ("", draw.choice([str.lower, str.capitalize, str.capitalize, str.upper])(long_word())),
        lambda: ("", draw.choice([str.lower, str.capitalize])(unknown_word())),
        lambda: ("", pick(digits, draw.choice([16, 18, 20]))),
        lambda: ("", long_word() + draw.choice([".", ",", "!", "###"])),
        lambda: (draw.choice(["commit", "revision", "sha1", "sha256:", "checksum", "etag", "integrity"]), pick(hexa, draw.choice([32, 40, 64]))),
        lambda: (draw.choice(["uuid", "id", "guid"]), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12))),
        lambda: ("", f"/{prose()}/{long_word()}/{prose()}.{draw.choice(['html', 'png', 'js', 'txt'])}"),
        lambda: ("", f"https://{prose()}.example.com/{long_word()}/{pick(digits, 4)}"),
        lambda: (f"{name()} =", f'"{draw.choice(["your-api-key-here", "xxxxxxxxxxxxxxxxxxxx", "example-password-value", "0000000000000000", "test_token_placeholder"])}"'),
        lambda: ("", "_".join(draw.choice(WORD_PARTS[56:]) for _ in range(4))),
        lambda: ("", draw.choice("=-_+") * draw.randint(16, 60)),
        lambda: ("", "-".join(draw.choice(WORD_PARTS[:56]) for _ in range(5))),
    ]
    made = []
    for i in range(rows):
        lead, word = draw.choice(secret if i % 2 else harmless)()
        made.append((f"{prose()} {prose()} {lead}".strip(), word, prose(), float(i % 2)))
    return spark.createDataFrame(made, "before string, word string, after string, label double")


def train(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 17) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(with_value(findings))).select("features", "label").coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def as_expression(model: RandomForestClassificationModel) -> Column:
    """The forest's mean share of secrets in the leaves, as an expression over the feature columns."""

    def walk(node) -> Column:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / (stats[0] + stats[1])))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    trees = [walk(tree._call_java("rootNode")) for tree in model.trees]
    return reduce(lambda a, b: a + b, trees) / len(trees)


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, place, run, value, before, score and secret of each candidate; false positives are those with secret = false.

    Null and empty texts have no candidates. Rows that repeat an id each give theirs; a null id stays null. Other columns
    are ignored. Candidates of any length are judged whole, and a word gives one for each of its runs.
    """
    model = model or train(labelled_findings(docs.sparkSession))
    found = with_features(candidates(docs, id_col, text_col)).withColumn("score", as_expression(model))
    return found.select("doc_id", "place", "run", "value", "before", "score", (F.col("score") >= min_score).alias("secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "place", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 9).alias("score"), "secret")
