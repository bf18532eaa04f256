"""Operator 8 against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from tessera.llm import repeats


def brute(texts: list[str | None], width: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, d in enumerate(data):
        for s in range(len(d) - width + 1):
            seen[d[s : s + width]].append((i, s))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + width] = b"\1" * width
    out = []
    for d, g in zip(data, gone):
        spans = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
        out.append((len(d), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(d, g) if not x)).hexdigest()))
    return out


def fixture() -> list[str | None]:
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "中文", "x"]
    say = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))
    base = [say(rnd.randint(1, 150)) for _ in range(40)]
    passage = say(60)
    texts: list[str | None] = [*base, base[0], base[0], None, "", "a" * 700, "a" * 350, "ab" * 300, "x" * 199, "y" * 200, "y" * 200]
    for i in range(12):  # a shared passage in different places
        texts.append(base[i] + passage + say(rnd.randint(0, 40)))
    for i in range(20, 30):  # near copies
        w = base[i].split(" ")
        if len(w) > 50:
            w[25] = "changed"
        texts.append(" ".join(w))
    texts.append(base[5] + base[6] + base[5])
    return texts


def run(spark, texts, width=200):
    rows = [(i, t, "zz") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lo string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, width).collect()}
    return [got[i] for i in range(len(texts))]


def test_equals_brute_force(spark):
    texts = fixture()
    want = brute(texts, 200)
    assert sum(x[1] for x in want) > 5000
    assert run(spark, texts) == want


def test_hot_digits_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_KINDS", 2)
    monkeypatch.setattr(repeats, "GROUP_ROWS", 3)
    texts = fixture()
    assert run(spark, texts) == brute(texts, 200)


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 1 << 10)
    rnd = random.Random(3)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = say(3000), say(2500)
    texts = [a + b, b[100:2300] + say(900), say(4000), a[1200:1600]]
    rows = list(enumerate(texts))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 2, 3, 4]), pa.array([0, 0, 0, 0])], names=["t", "a", "b"])
    runs = [x for part in repeats._runs(batch, 200) for x in part.to_pylist()]
    for i, t in rows:  # every window is in exactly one run
        windows = sorted(w for x in runs if x["r1"] == i + 1 for w in range(x["lo"], x["lo"] + x["more"] + 1))
        assert windows == list(range(max(0, len(t) - 199)))
    assert run(spark, texts) == brute(texts, 200)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(df).count() == 0
    rows = [(None, "q" * 50 + "r" * 250), (None, "q" * 50 + "r" * 250), (7, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (True, 300), (True, 300)]
