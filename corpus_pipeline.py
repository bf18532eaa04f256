"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Each stage's decisions take effect: documents that the quality rules reject, all but
one of each group of near duplicates, and documents that hold a benchmark item go; personal data
become surrogates; and the last stage samples documents to the target mixture and adds topic,
n_tokens, probability and weight.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, remove, removed_at_exit, shared_folder, table, text_key
from tessera.llm.leaks import without_leaks
from tessera.llm.mixing import mix
from tessera.llm.near import near_links
from tessera.llm.pii import replace_personal_data
from tessera.llm.quality import apply_rules
from tessera.llm.queries import personal_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id, then the smallest text key."""
    sets, labels = near_links(docs)
    named = sets.join(labels, "node", "left").select("r1", "r2", F.coalesce("component", "node").alias("label"))
    keys = dict(zip(("r1", "r2"), text_key(F.col("text"))))
    rows = docs.select("doc_id", *[c.alias(n) for n, c in keys.items()]).join(named, ["r1", "r2"])
    rows = checkpointed(rows)
    # a text without words is in no group
    stay = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("x"))
    stay = stay.select("x.doc_id", "x.r1", "x.r2").unionAll(rows.where("label is null").select("doc_id", "r1", "r2").distinct())
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("r1").alias("__r1"), F.col("r2").alias("__r2"))
    keyed = docs.withColumns({f"__{n}_": c for n, c in keys.items()})
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["__id"]) & (keyed["__r1_"] == stay["__r1"]) & (keyed["__r2_"] == stay["__r2"]), "left_semi")
    if not rows.groupBy("doc_id", "r1", "r2").count().where("count > 1").isEmpty():
        # rows that repeat in id and text are one document; without any, texts needn't be dealt again
        kept = kept.dropDuplicates(["doc_id", "__r1_", "__r2_"])
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = replace_personal_data(docs, personal_key())
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("kept").drop("kept")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", personal_data),
    ("source_mixing", mixing),
]

#: Keyed surrogates, components and raking have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, through Parquet in the shared checkpoint folder.

    A stage's output goes when the next one is written; the last one's, which the result reads, when the process ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    removed_at_exit(spark, folder)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
