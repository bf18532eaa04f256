"""Secret findings with a random forest that removes false positives (operator 5).

One pattern proposes candidates: long tokens with a digit, quoted values assigned to something, values
of eight characters or more assigned to a name with a word that announces secrets, known key prefixes.
A forest over each candidate's length, character transitions, dictionary coverage, path marks and
neighbouring words decides.  It is trained on labelled findings; those given here are made by
``labelled_findings`` (a fixed number of rows, drawn by hashing row numbers): keys,
tokens and passwords of many shapes against identifiers, digests, paths, numbers and placeholders
in the surroundings where they occur.

Extraction, features, training (the JVM library's forest) and scoring are DataFrame functions; there
is no user function in any of them, and scoring is one map over the documents without a shuffle.

Rows: null and empty texts have no candidates; repeated rows give repeated findings; very long texts
are read whole; other columns are ignored.  Findings carry the candidate's ordinal in its text and
its SHA-256, never the value.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_ROWS, TREES, DEPTH, SEED = 6000, 24, 8, 5
THRESHOLD = 0.5
_T = r"[A-Za-z0-9_+/=.~-]"
# Words that announce secrets.
NEAR_GOOD = "token|secret|password|passwd|pwd|apikey|api_key|api-key|access_key|accesskey|auth|bearer|credential|private|key"
#: A name with such a word in any case, and what assigns a value to it; the word "bearer" alone does.
_KEY = rf"(?i:{NEAR_GOOD})[A-Za-z0-9_.-]{{0,24}}[\"']?[ \t]{{0,4}}(?:=>|:=|[:=])[ \t]{{0,4}}[\"']?|(?i:bearer) "
CANDIDATE = (
    rf"(?<!{_T})(?![A-Za-z0-9_.-]*(?i:{NEAR_GOOD})[A-Za-z0-9_.-]{{0,24}}=[^=\"'\s]{{8}})(?=[A-Za-z_+/=.~-]*[0-9]){_T}{{16,}}(?!{_T})"
    r"|(?<=[:=] ?[\"'])[^\"'\s]{8,}(?=[\"'])"
    rf"|(?<=[:=>][ \t]{{0,4}}[\"']?|[Rr] )(?<={_KEY})[^\"'\s]{{8,}}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)

# Words that announce other opaque strings, frequent parts of words and names, and frequent letter pairs.
NEAR_BAD = "commit|sha1|sha256|sha|md5|checksum|digest|hash|uuid|guid|etag|revision|example|sample|placeholder|isbn|order|invoice|version|build|image|file|path|url"
PARTS = "the|and|ing|ion|ent|for|tion|con|data|user|name|file|test|main|item|list|code|type|time|page|view|text|form|info|config|service|server|client|message|request|response|value|index|number|string|object|array|class|error|event|example|your|here|change|default|public|static|http|https|www|com|org|net|html|json|image|assets|src|lib|bin|usr|var|home|docs|build|release|version|latest|master|branch|feature|update|create|delete|insert|select|get|set|new|old|key|token|word|pass|abc|xxx"
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.|-----BEGIN )"
FEATURES = ["length", "moves", "pairs", "covered", "slashes", "dots", "upper", "lower", "digits", "hex", "kinds", "known", "near_good", "near_bad", "assigned", "quoted", "path_before"]


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.char_length(value)
    low = F.lower(value)
    covered = n - F.char_length(F.regexp_replace(low, PARTS, ""))
    moves = F.size(F.regexp_extract_all(value, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"), F.lit(0)))
    pairs = F.size(F.regexp_extract_all(low, F.lit("|".join(PAIRS.split())), F.lit(0)))
    near = F.lower(F.right(before, F.lit(32)))
    letters = F.greatest(_count(low, "[a-z]"), F.lit(1))
    out = {
        "length": F.least(n, F.lit(200)),
        "moves": moves / n,
        "pairs": 2 * pairs / letters,
        "covered": covered / n,
        "slashes": _count(value, "[/]") / n,
        "dots": _count(value, "[._-]") / n,
        "upper": _count(value, "[A-Z]") / n,
        "lower": _count(value, "[a-z]") / n,
        "digits": _count(value, "[0-9]") / n,
        "hex": F.when(low.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0),
        "kinds": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(62)),
        "known": F.when(value.rlike(KNOWN), 1.0).otherwise(0.0),
        "near_good": F.when(near.rlike(f"(?:{NEAR_GOOD})"), 1.0).otherwise(0.0),
        "near_bad": F.when(near.rlike(f"(?:{NEAR_BAD})"), 1.0).otherwise(0.0),
        "assigned": F.when(before.rlike("[:=] ?[\"']?$"), 1.0).otherwise(0.0),
        "quoted": F.when(before.rlike("[\"']$"), 1.0).otherwise(0.0),
        "path_before": F.when(before.rlike("[/\\\\]$") | after.rlike("^[/\\\\]"), 1.0).otherwise(0.0),
    }
    return {k: c.cast("double") for k, c in out.items()}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, value, before, after) of each candidate in a text."""
    text = F.col(text_col)
    # the longest run of word characters decides cheaply that most texts have no candidate
    found = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("values"), text.alias("text")).where(F.size("values") > 0)
    found = found.withColumn("parts", F.split("text", CANDIDATE, -1))
    around = F.arrays_zip("values", F.transform(F.slice("parts", 1, F.size("values")), lambda p: F.right(p, F.lit(40))).alias("before"), F.transform(F.slice("parts", 2, F.size("values")), lambda p: F.left(p, F.lit(20))).alias("after"))
    found = found.select("doc_id", F.posexplode(around).alias("ordinal", "x"))
    return found.select("doc_id", "ordinal", F.col("x.values").alias("value"), F.col("x.before").alias("before"), F.col("x.after").alias("after"))


def labelled_findings(spark: SparkSession, n: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """(value, before, after, label): made-up findings, half of them secrets."""
    i = F.col("id")
    draw = lambda k, m: F.pmod(F.xxhash64(i, F.lit(seed * 1000 + k)), F.lit(m)).cast("int")
    pick = lambda k, *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), draw(k, len(xs)))

    def chars(alphabet: str, k: int, length) -> Column:
        length = F.lit(length) if isinstance(length, int) else length
        return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda j: F.substr(F.lit(alphabet), F.pmod(F.xxhash64(i, j, F.lit(seed * 1000 + k)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))), "")

    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    words = [w for w in PARTS.split("|") if len(w) > 2]
    word = lambda k: pick(k, *words[k % 7 :: 3])
    alnum = low + up + num
    secret = pick(1,
        chars("0123456789abcdef", 10, 40), chars("0123456789abcdef", 11, 32), chars("0123456789abcdef", 12, 64), chars(alnum, 13, 24 + draw(14, 30)),
        F.concat(F.lit("AKIA"), chars(up + num, 15, 16)), F.concat(F.lit("ghp_"), chars(alnum, 16, 36)), F.concat(F.lit("sk-"), chars(alnum, 17, 40)),
        F.concat(chars(alnum + "+/", 18, 38), F.lit("==")), chars(alnum + "!@#$%^&*", 19, 10 + draw(20, 10)), F.concat(F.lit("xoxb-"), chars(num, 21, 11), F.lit("-"), chars(alnum, 22, 24)),
        F.concat(F.lit("eyJ"), chars(alnum, 23, 20), F.lit("."), chars(alnum, 24, 40)), chars(alnum + "_-", 25, 43), F.lit("-----BEGIN RSA PRIVATE KEY-----"),
    )
    key = pick(2, "token", "api_key", "secret", "password", "access_key", "auth", "Bearer", "private_key", "client_secret", "API-KEY", "key")
    secret_before = pick(3, F.concat(key, F.lit(" = \"")), F.concat(key, F.lit("=")), F.concat(key, F.lit(": ")), F.concat(key, F.lit(" ")), F.concat(word(30), F.lit(" "), key, F.lit(" = '")), F.concat(key, F.lit(":\"")))
    other = pick(4,
        F.concat_ws("_", word(40), word(41), word(42), draw(43, 100).cast("string")), F.concat_ws("/", word(44), word(45), word(46), F.concat(word(47), draw(48, 1000).cast("string"), F.lit(".html"))),
        chars("0123456789abcdef", 49, 40), chars("0123456789abcdef", 50, 64), F.concat_ws("-", chars("0123456789abcdef", 51, 8), chars("0123456789abcdef", 52, 4), chars("0123456789abcdef", 53, 4), chars("0123456789abcdef", 54, 4), chars("0123456789abcdef", 55, 12)),
        chars(num, 56, 16 + draw(57, 6)), F.concat_ws(".", word(58), word(59), word(60), draw(61, 10).cast("string")), F.concat(F.lit("your-"), word(62), F.lit("-here-1234567")), F.concat(F.lit("xxxxxxxxxxxxxxxx"), draw(63, 10).cast("string")),
        F.concat(F.initcap(word(64)), F.initcap(word(65)), F.initcap(word(66)), draw(67, 1000).cast("string")), F.concat(draw(68, 28).cast("string"), F.lit("-"), word(69), F.lit("-2020-"), word(70), F.lit(".json")), F.concat(word(71), F.lit("."), draw(72, 100).cast("string"), F.lit("mail.example.com")),
        F.concat_ws("", *[word(73 + k) for k in range(5)], draw(79, 10).cast("string")),
    )
    opaque = other.rlike("^[0-9a-f-]{32,}$")
    plain = pick(5, F.concat(word(80), F.lit(" ")), F.concat(word(81), F.lit(" = \"")), F.lit("see "), F.lit("https://"), F.lit("id: "), F.concat(word(82), F.lit(": ")), F.lit("\""), F.lit("to "))
    digest = F.concat(pick(6, "commit", "sha256", "md5", "checksum", "uuid", "etag", "hash", "revision", "digest"), pick(7, " ", ": ", "=", " = \""))
    label = i % 2
    value = F.when(label == 1, secret).otherwise(other)
    before = F.when((label == 1) & secret.rlike(KNOWN) & (draw(31, 2) == 0), plain).when(label == 1, secret_before).otherwise(F.when(opaque, digest).otherwise(plain))
    lead = pick(8, F.lit(""), F.concat(word(90), F.lit(" ")), F.concat(word(91), F.lit("\n")), F.concat(word(92), F.lit(" "), word(93), F.lit(" ")))
    return spark.range(n).select(value.alias("value"), F.concat(lead, before).alias("before"), pick(9, "", "\"", " ", "\n", ", ", ".", " the").alias("after"), label.cast("double").alias("label"))


def _vectors(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({f"f_{k}": c for k, c in features(F.col("value"), F.col("before"), F.col("after")).items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)


def train(labelled: DataFrame):
    """A forest from labelled findings (value, before, after, label)."""
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(_vectors(labelled).select("features", "label"))


def findings(docs: DataFrame, model=None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, length, value_sha256, score) of the candidates that the forest keeps."""
    model = model or train(labelled_findings(docs.sparkSession))
    scored = model.transform(_vectors(candidates(docs, id_col, text_col))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.where(F.col("score") >= threshold).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.char_length("value").cast("bigint").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score")
