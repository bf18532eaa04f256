"""Every registered query of the reference's operators: SQL side by side, or rows and a stable schema."""

from __future__ import annotations

import pytest

from tessera.plans.oracles import SQL
from tessera.plans.queries import REGISTRY
from tests import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert oracle.differences(spark, name, SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_gives_rows(spark, name):
    df = REGISTRY[name](spark, SMALL)
    assert df.count() > 0 and df.schema == REGISTRY[name](spark, SMALL).schema


def test_registry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'plan_chunks' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_chunks_are_exact_slices(spark):
    from pyspark.sql import functions as F

    from tessera.operators import planning

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lines = planning.lines(docs).withColumnRenamed("text", "line")
    chunks = planning.plan_chunks(docs)
    joined = chunks.join(lines, ["doc_id", "para"])
    assert joined.where(F.substr("line", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")).count() == 0
    assert chunks.select("id").distinct().count() == chunks.count()
    assert chunks.where((F.col("words") > 85) & (F.col("s1") - F.col("s0") > 1)).count() == 0


def test_chunks_that_end_in_figures(spark):
    """A sentence keeps the figure that equals its place in the line, and so do a chunk's end and hash."""
    import hashlib

    from tessera.operators import planning

    line = "One. 21"
    row = planning.plan_chunks(spark.createDataFrame([(1, line)], "doc_id bigint, text string")).first()
    assert (row.end, row.text_sha256) == (len(line), hashlib.sha256(line.encode()).hexdigest())


def test_turns_are_read_whole(spark):
    """Alignments reach past the 80th token, and a turn's end is its last five tokens."""
    import re

    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "text").collect()
    words = {(r.conv_id, r.turn): [w for w in re.split("[^a-z0-9]+", (r.text or "").lower()) if w] for r in rows}
    before = {}
    for conv in {c for c, _ in words}:
        turns = sorted(t for c, t in words if c == conv)
        before |= {(conv, b): words[conv, a] for a, b in zip(turns, turns[1:])}
    assert any(len(w) > 80 for w in before.values())
    ends = {(r.conv_id, r.turn): r.expected for r in REGISTRY["terminal_suffix"](spark, SMALL).collect()}
    assert ends == {k: " ".join(w[-5:]) for k, w in before.items()}
    sizes = {(r.conv_id, r.turn): r.expected_tokens for r in REGISTRY["turn_coverage"](spark, SMALL).collect()}
    assert any(n > 80 for n in sizes.values())
    at = REGISTRY["fuzzy_alignment"](spark, SMALL).collect()
    assert max(r.expected_at for r in at) >= 80 and max(r.heard_at for r in at) >= 80


@pytest.mark.parametrize("name", ["ngram_repetition", "loop_repetitions"])
def test_ngrams_are_not_broadcast(spark, name):
    """Spark estimates exploded n-grams by their texts; all of them would pass through the driver."""
    assert "Broadcast" not in REGISTRY[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_units_are_packed_without_a_shuffle(spark):
    assert "Exchange" not in REGISTRY["plan_units"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
