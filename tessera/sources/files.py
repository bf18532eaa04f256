"""Sampled audio files, tolerant JSON records, append-only ledgers, manifests and chapter metadata."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.udf import mapped
from tessera.operators.state import RELEASED


def parse_wav(content: bytes) -> dict | None:
    """Facts and samples of a 16-bit RIFF file; None if it is none."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, b""
    while at + 8 <= len(content):
        tag, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if tag == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
        elif tag == b"data":
            data = body
        at += 8 + size + size % 2
    if not form or form[0] != 1 or form[5] != 16:
        return None
    n = len(data) // 2
    return {"channels": form[1], "sample_rate": form[2], "subtype": "PCM_16", "samples": [s / 32768.0 for s in struct.unpack(f"<{n}h", data[: 2 * n])]}


@mapped("struct<channels:int,sample_rate:int,subtype:string,samples:array<double>>")
def wav_of(content):
    return parse_wav(content)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, channels, sample_rate, subtype, samples) of audio files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), wav_of("content").alias("w")).select("path", "sha256", "bytes", "w.*")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one a line; lines that aren't JSON are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, place): distinct ids, one a line, trimmed; place orders them as they first stand in their file."""
    lines = spark.read.option("wholetext", "true").text(path)  # lists of ids are small files
    each = lines.select(F.posexplode(F.split("value", "\n")).alias("place", "id")).select(F.trim("id").alias("id"), "place")
    return each.where("id <> ''").groupBy("id").agg(F.min("place").alias("place"))


def read_specs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unit specifications of JSON files that hold a list, or an object with the list as its chunks; anything else is an error."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.btrim("value").alias("value"))
    chunks = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.chunks"))
    no_list = F.raise_error(F.lit("specifications must be a JSON list or an object with a list of chunks"))
    return whole.select(F.inline(F.when(F.coalesce(chunks.startswith("["), F.lit(False)), F.from_json(chunks, f"array<struct<{schema}>>")).otherwise(no_list)))


def append_ledger(decisions: DataFrame, path: str) -> None:
    decisions.select("id", "parent_id", "decision", "detail").write.mode("append").json(path)


def manifest(decisions: DataFrame) -> DataFrame:
    """(decision, units, released) in order: how many units each decision has."""
    return decisions.groupBy("decision").agg(F.count("*").alias("units")).withColumn("released", F.col("decision").isin(*RELEASED)).orderBy("decision")


def write_manifest(decisions: DataFrame, path: str) -> None:
    """counts: a JSON row a decision; excluded: the ids left out, a JSON row each, sorted (as many files as it takes)."""
    manifest(decisions).coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    decisions.where(~F.col("decision").isin(*RELEASED)).select("id", "decision").orderBy("id").write.mode("overwrite").json(f"{path}/excluded")


def metadata_escape(value: Column) -> Column:
    """Backslash before backslash, newline, = ; and #."""
    return F.regexp_replace(value, r"([\\\n=;#])", r"\\$1")


def chapter_metadata(chapters: DataFrame, order: str) -> DataFrame:
    """One text: a CHAPTER block for each (title, start_ms, end_ms) row in order.  One row a chapter of one book."""
    block = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), metadata_escape(F.col("title")))
    return chapters.agg(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))).alias("x")).select(F.array_join(F.col("x.b"), "\n").alias("text"))


def input_errors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, problem) of inputs that are missing or differ from their expected sha256."""
    both = expected.select("path", F.col("sha256").alias("want")).join(actual.select("path", F.col("sha256").alias("got")), "path", "left")
    return both.where(F.col("got").isNull() | (F.col("got") != F.col("want"))).select("path", F.when(F.col("got").isNull(), "missing").otherwise("differs").alias("problem"))
