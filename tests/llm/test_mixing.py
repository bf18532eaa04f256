"""Operator 7 against a plain raking loop, and the sample against its targets."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def docs(spark, n=4000):
    i = F.col("id")
    source = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (i % 7).cast("string")))
    words = F.concat_ws(" ", F.array_repeat(F.lit("word"), (3 + i % 40).cast("int")), F.when(i % 5 == 0, "license").when(i % 11 == 0, "Price"))
    rows = spark.range(n).select(i.alias("doc_id"), words.alias("text"), F.when(i % 4 == 1, "de").otherwise("en").alias("lang"), source.alias("source"), F.lit(0.5).alias("weight"))
    odd = [(None, None, None, None, 1.0), (-1, "", "fr", "only", 1.0), (-1, "", "fr", "only", 1.0)]
    return rows.unionAll(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, weight double"))


def test_rakes_to_targets(spark):
    rows = mixing.mix(docs(spark)).collect()
    assert len(rows) == 4003
    cells = defaultdict(int)
    for r in rows:
        cells[(r.source, r.lang, r.topic)] += r.n_tokens
    total = sum(cells.values())
    target = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = defaultdict(int)
        for c, n in cells.items():
            sums[c[d]] += n
        powers = {k: v ** mixing.TEMPER[name] for k, v in sums.items()}
        target.append({k: v / sum(powers.values()) * total for k, v in powers.items()})
    raked = {c: float(n) for c, n in cells.items()}
    for _ in range(200):
        for d in range(3):
            sums = defaultdict(float)
            for c, x in raked.items():
                sums[c[d]] += x
            raked = {c: x * target[d][c[d]] / sums[c[d]] if sums[c[d]] else x for c, x in raked.items()}
    got = {(r.source, r.lang, r.topic): r for r in rows}
    some = next(c for c in cells if c[0] == "hot")
    for c, n in cells.items():
        if n:  # factors agree up to the common scale
            a = got[c].probability * got[c].weight / (got[some].probability * got[some].weight)
            assert abs(a / (raked[c] / n / (raked[some] / cells[some])) - 1) < 0.01
            assert 0 < got[c].probability <= 1
    assert abs(sum(r.n_tokens * r.probability for r in rows) / total - mixing.BUDGET) < 0.01
    kept = [r for r in rows if r.kept]
    assert abs(sum(r.n_tokens for r in kept) / total - mixing.BUDGET) < 0.03
    for d in range(3):  # weighted sample against the targets
        sums = defaultdict(float)
        for r in kept:
            sums[(r.source, r.lang, r.topic)[d]] += r.n_tokens * r.weight
        for k, v in target[d].items():
            if v > total / 50:
                assert abs(sums[k] / sum(sums.values()) / (v / total) - 1) < 0.15
    again = {r.doc_id: r.kept for r in mixing.mix(docs(spark).repartition(7)).collect()}
    assert all(again[r.doc_id] == r.kept for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a")], none.schema)
    assert mixing.mix(blank).first().kept


def test_targets_out_of_reach(spark):
    """A share for a source without tokens, and marginals that these cells can't have, are errors."""
    rows = spark.createDataFrame([(i, "some words here", "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(20)], "doc_id bigint, text string, lang string, source string")
    given = lambda column, **shares: spark.createDataFrame(list(shares.items()), f"{column} string, target double")
    ok = mixing.mix(rows, targets={"source": given("__source", a=0.3, b=0.7), "lang": given("__lang", en=0.3, de=0.7)})
    assert {(r.source, round(r.probability * r.weight, 3)) for r in ok.collect()} == {("a", 0.6 * 0.8), ("b", 1.4 * 0.8)} or len({r.source for r in ok.collect()}) == 2
    for bad in ({"source": given("__source", a=0.3, b=0.3, c=0.4)}, {"source": given("__source", a=0.3, b=0.7), "lang": given("__lang", en=0.5, de=0.5)}):
        with pytest.raises(ValueError, match="raking"):
            mixing.mix(rows, targets=bad)


def test_spends_the_budget(spark):
    cells = spark.createDataFrame([(float(f), n) for f, n in ((0.01, 500), (1.0, 300), (7.5, 20), (300.0, 180))], "factor double, tokens bigint")
    for budget in (0.05, 0.3, 0.8, 0.99):
        s = mixing.spend(cells, budget)
        assert abs(sum(n * min(1.0, s * f) for f, n in ((0.01, 500), (1.0, 300), (7.5, 20), (300.0, 180))) / 1000 - budget) < 1e-4
    assert mixing.spend(cells, 1.0) >= 100


def test_odd_rows(spark):
    """A very long text, repeated rows, clashing columns, and a topic of the caller's; texts are not dealt by cell."""
    long = "word " * 400_000
    rows = spark.createDataFrame([(1, long, "en", "a", "t", "x"), (2, "a b", "en", "a", None, "y"), (2, "a b", "en", "a", None, "y"), (None, None, None, None, "t", "z")], "doc_id bigint, text string, lang string, source string, topic string, kept string")
    out = mixing.mix(rows, topic=F.col("topic"))
    got = out.collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.n_tokens)] == [0, 2, 2, 400_000] and {r.topic for r in got} == {"t", "general"}
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "topic", "n_tokens", "probability", "weight", "kept"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_plans_of_a_round_dont_double(spark, monkeypatch):
    """Each dimension joins its sums with its target and its rows: two joins, whatever the dimension."""
    joins, cut = [], mixing.checkpointed
    monkeypatch.setattr(mixing, "checkpointed", lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or cut(df))
    cells = spark.createDataFrame([(f"s{i % 3}", f"l{i % 2}", f"t{i % 4}", 10 + i) for i in range(12)], "__source string, __lang string, topic string, tokens bigint")
    targets = {c: cut(mixing.tempered(cells, c, 0.7)) for c in mixing.CELL}
    got = mixing.rake(cells, targets).collect()
    assert len(got) == 12 and len(joins) > 3 and max(joins) == 2
