"""The pipeline on small tables, stage by stage against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_near import brute


def passage(rnd, n):
    return " ".join("".join(rnd.choice(["ka", "lo", "mi", "ter", "sun", "the", "of"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def make(rnd):
    docs, item = [], passage(rnd, 40)
    for i in range(80):
        docs.append((i, f"The start of it and {passage(rnd, rnd.randint(60, 150))}.", ["en", "de"][i % 2], f"s{i % 5}"))
    docs += [(100 + i, docs[3][1], "en", "s0") for i in range(6)]
    docs += [(120 + i, docs[4][1] + f" extra{i}", "en", "s0") for i in range(6)]
    docs += [(140, docs[0][1] + " " + item + " the of", "en", "s1"), (141, "too short of the", "en", "s1"), (142, "the of ### " * 60, "en", "s1")]
    docs += [(150, docs[7][1][:-1] + " write to some.one@mail.example.com of the 4785380592391139.", "en", "s2"), (151, None, "en", "s2"), (152, "", None, None), (7, docs[7][1], "de", "s2")]
    rnd.shuffle(docs)
    return [(*d[:2], *d[2:], len(d[1] or "")) for d in docs], item


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    rows, item = make(rnd)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "source_mixing":
            assert out.columns == names and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = lambda s: sorted(r.doc_id for r in seen[s])
    good = [r for r in rows if r[0] not in (141, 142, 151, 152)]
    assert ids("quality_rules") == sorted(r[0] for r in good)
    groups = defaultdict(set)
    for r, (_, c) in zip(good, brute([r[1] for r in good])):
        groups[c].add(r[0])
    assert ids("ngram_jaccard") == sorted(min(g) for g in groups.values())
    assert ids("benchmark_decontamination") == [i for i in ids("ngram_jaccard") if i != 140]
    assert ids("pii_surrogates") == ids("benchmark_decontamination")
    private = [r.text for r in seen["pii_surrogates"] if re.search(r"@|\d{16}", r.text)]
    assert all("some.one@" not in t and "4785380592391139" not in t for t in private)
    assert all(r.n_chars == len(r.text) for r in seen["pii_surrogates"])
    assert set(ids("source_mixing")) < set(ids("pii_surrogates")) and len(ids("source_mixing")) > 0.5 * len(ids("pii_surrogates"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(whole) == sorted(seen["source_mixing"])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
