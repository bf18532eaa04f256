"""Quality rules: a threshold table compiled into one projection (operator 1).

Every measure is a column expression of built-in functions over the text and its words; the rules
are rows (name, measure, low, high) that become ``measure between low and high`` conditions of the
same projection.  There is no shuffle and no user function, so the operator runs inside the scan's
stage at any size.

Rows: a null text has no words, lines or symbols (it fails the base rule like an empty one); repeated
rows are judged alike; very long texts are judged whole; a clashing output column replaces the
input's.  Measures that divide by the number of words are null for a text without words, and a null
measure passes its rule (such a text fails the base rule anyway).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_SEPARATORS

# Frequent function words of the four corpus languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was be with as this by at are from",
    "de": "der die das und in zu den von mit sich auf für ist im dem nicht ein eine als auch an er",
    "fr": "le la de et les des en un une du que qui dans pour est par sur au avec il ne pas",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
UPPER = r"[A-ZÄÖÜÉÈÊÇÑÍÓÁÚÀÂÎÔÛ]+"


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.35),
    Rule("upper_case", "upper_ratio", None, 0.5),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
    Rule("stop_words", "n_stop_words", 2, None),
)

BASE_LEAST_WORDS = 50
#: Lines added to a text's own, so that one repeated heading doesn't condemn a text of three lines.
LINE_PRIOR = 5
BASE_REPEAT_PERCENT = 50


def base_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the helpers that rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "upper_chars", "n_stop_words"]
    df = df.drop(*made)
    stops = F.array(*[F.lit(w) for w in sorted({w for words in STOP_WORDS.values() for w in words.split()})])
    df = df.withColumns({
        "__words": F.array_remove(F.split(text, WORD_SEPARATORS), ""),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
    })
    n = F.size("__words")
    df = df.withColumn("__hashes", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))))
    # windows found twice or more lie beside an equal one in sorted order
    df = df.withColumn("__sorted", F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    twice = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
    df = df.withColumn("__twice", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate("__twice", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]
    measured = df.withColumns({
        "__row": F.monotonically_increasing_id(),
        "n_words": n.cast("bigint"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("bigint"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
        "upper_chars": (F.char_length(text) - F.char_length(F.regexp_replace(text, UPPER, ""))).cast("bigint"),
        "n_stop_words": F.size(F.array_intersect("__words", stops)).cast("bigint"),
    }).drop("__words", "__lines", "__hashes", "__sorted", "__twice")
    # a filter on a measure stops at the row number's projection; below it the optimizer would copy the
    # measures' nested expressions into the filter, many times over
    return measured.withColumns({m: F.when(F.col("__row") >= 0, F.col(m)) for m in made}).drop("__row")


def measures() -> dict[str, Column]:
    """Measures that rules may name."""
    words, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": F.col("upper_chars") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / (F.col("n_lines") + LINE_PRIOR),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "n_stop_words": F.col("n_stop_words"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(kept, names of the rules that reject) as column expressions over base_measures."""
    known = measures()
    broken = []
    for r in rules:
        m = known[r.measure]
        parts = [m < r.low] * (r.low is not None) + [m > r.high] * (r.high is not None)
        bad = parts[0] if len(parts) == 1 else parts[0] | parts[1]
        broken.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    names = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return F.size(names) == 0, names


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Append the measures, base_failed, kept and rejected_by."""
    out = base_measures(df.drop("base_failed", "kept", "rejected_by"), text_col)
    _, names = compile_rules(rules)
    failed = (F.col("n_words") < BASE_LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "rejected_by": names})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
