"""Operator 6 against all pairs."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and 100 * shared >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def fixture():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "中文", "The"]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = []
    line = say(12)
    for _ in range(25):
        base = say(rnd.choice([3, 5, 9, 40, 120, 300]))
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 4, 9])):  # near and not so near copies, chains of edits
            for _ in range(rnd.randint(0, 3)):
                base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append("\n\t ".join(base) if rnd.random() < 0.3 else " ".join(base))
    texts += [" ".join(say(60) + line + say(50)) for _ in range(30)]  # a common line
    texts += [None, "", " \n ", "one two", "One  TWO", "one", texts[0], texts[0].upper()]
    same = say(100)  # exactly on the limit: sets of 96 with 4 edges apart
    texts += [" ".join(same), " ".join(same + say(24)), " ".join(same[:75])]
    return texts


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, node int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_components(df).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("tile,frequent", [(1000, 16), (3, 4)])
def test_equals_all_pairs(spark, monkeypatch, tile, frequent):
    monkeypatch.setattr(near, "TILE", tile)
    monkeypatch.setattr(near, "FREQUENT", frequent)
    texts = fixture()
    want = brute(texts)
    assert len({c for _, c in want}) < len(texts) - 40
    assert run(spark, texts) == want


def test_links_between_members_only(spark):
    """x - y link although the leader of their region links with neither."""
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(2)]
    a = np.sort(np.concatenate([sets[0], sets[1][:10]]))
    b, c = np.sort(np.concatenate([sets[1], a[:3]])), np.sort(np.concatenate([sets[1][:58], a[:3]]))
    assert near.region_links([1, 2, 3], [1, 2, 3], [a, b, c]) == [(2, 3)]


def test_pairs_with_leaders_are_not_compared_again(spark):
    """Regions: 1 with 2; 3 with 4 and 5, which are one component; 6 with 7, 8 and 9."""
    regions = spark.createDataFrame([(1, 2), (3, 4), (3, 5), (6, 7), (6, 8), (6, 9)], "leader bigint, node bigint")
    labels = spark.createDataFrame([(4, 4), (5, 4), (6, 6), (7, 6)], "node bigint, component bigint")
    got = near.open_members(regions, labels).collect()
    assert sorted((r.leader, r.node, r.comp, r.parts) for r in got) == [(6, 7, 6, 1), (6, 8, 8, 1), (6, 9, 9, 1)]


def test_workers_hold_a_part_of_a_batch():
    """A batch of 80 MB of texts in pairs: the shingles of a part are there at once, not those of all."""
    text = " ".join(f"w{i * i % 7919}" for i in range(1000))
    n = 40_000_000 // len(text)
    texts = pa.array([f"{i} {text}" for i in range(n)])
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, texts, texts], names=["a", "b", "ta", "tb"])
    list(near._verified([batch.slice(0, 10)]))  # tables that are kept
    tracemalloc.start()
    rows = sum(len(x) for x in near._verified([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 120_000_000, peak


def test_bound_never_prunes_a_link():
    rnd = np.random.default_rng(2)
    base = np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(200, 400), replace=False), rnd.integers(0, 2**63, rnd.integers(0, 120)).astype(np.uint64)])) for _ in range(120)]
    points, sizes = np.array([near.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = near.CountTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.near(points[i], len(s)).tolist())
        assert {j for j, t in enumerate(sets) if near.links(len(s), len(t), near.overlap(s, t))} <= found


def test_empty(spark):
    assert near.near_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    got = near.near_components(spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (5, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 4), (0, 4), (4, 4), (5, 5)]
