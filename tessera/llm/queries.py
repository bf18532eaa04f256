"""The registered corpus queries: production parameters, whole tables, digest columns."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary file lies; TESSERA_TOKENIZERS overrides the installed package."""
    if folder := os.environ.get("TESSERA_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


QUALITY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import apply_rules

    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*QUALITY_COLUMNS)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokens import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


_RANDOM_KEY = secrets.token_hex(32)


def personal_key() -> str:
    """The secret of the surrogates: TESSERA_PII_KEY, or else a random one, which no one else has and which ends with the process."""
    return os.environ.get("TESSERA_PII_KEY") or _RANDOM_KEY


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import replace_personal_data

    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), personal_key())


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import findings

    return findings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near import near_components

    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).drop("text")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)


LEAK_COLUMNS = ["doc_id", "item_id", "matched_windows", "item_windows", "n_slots"]


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.leaks import leaked_pairs

    return leaked_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pages import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_lm_score": op4_lm_score,
        "op5_secret_scan": op5_secret_scan,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_source_mixing": op7_source_mixing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_benchmark_leaks": op9_benchmark_leaks,
        "op10_html_extraction": op10_html_extraction,
        "pipeline": pipeline,
    }


def quality_sql(source: str = "documents") -> str:
    """Common table expressions up to ``judged``: the rows of source with the quality measures and verdicts."""
    from tessera.llm.quality import BASE_LEAST_WORDS, BASE_REPEAT_PERCENT, LINE_PRIOR, RULES, STOP_WORDS, SYMBOLS, UPPER

    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    measure = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)",
        "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "upper_ratio": "upper_chars / nullif(word_chars, 0)",
        "dup_line_ratio": f"n_dup_lines / (n_lines + {LINE_PRIOR})",
        "n_stop_words": "n_stop_words",
    }
    bad = [f"coalesce({measure[r.measure]} < {r.low}, false)" for r in RULES if r.low is not None]
    bad += [f"coalesce({measure[r.measure]} > {r.high}, false)" for r in RULES if r.high is not None]
    return f"""
q_rows AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source}),
q_words AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM q_rows),
q_windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM q_words)),
q_twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM q_windows) WHERE c > 1),
q_covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM q_twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
q_base AS (SELECT q_words.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '{UPPER}', '', 'g')) AS upper_chars,
  len(list_intersect(list_distinct(ws), [{stops}])) AS n_stop_words
  FROM q_words LEFT JOIN q_covered USING (rid)),
q_failed AS (SELECT *, n_words < {BASE_LEAST_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM q_base),
judged AS (SELECT *, NOT base_failed AND NOT ({" OR ".join(bad)}) AS kept FROM q_failed)"""


def near_sql(source: str = "documents") -> str:
    """doc_id, n_shingles and component_id by all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {source}),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
e AS (SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT rid, doc_id AS d FROM w UNION SELECT e.b, r.d FROM r JOIN e ON e.a = r.rid)
SELECT any_value(w.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.d) AS component_id FROM w JOIN r ON r.rid = w.rid LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid"""


def oracle_sql() -> dict:
    from tessera.llm.leaks import leaks_sql

    return {
        "op6_ngram_jaccard": near_sql(),
        "op9_benchmark_leaks": f"WITH {leaks_sql()} SELECT DISTINCT {', '.join(LEAK_COLUMNS)} FROM leaked",
        "op1_quality_rules": f"WITH {quality_sql()} SELECT {', '.join(QUALITY_COLUMNS)} FROM judged",
    }
