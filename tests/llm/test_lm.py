"""Operator 4: exact counts and base scores, a proper distribution, and a gain on held-out text."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import lm


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]


def texts():
    rnd = random.Random(4)
    after = {"the": ["cat", "dog", "tree"], "of": ["the", "a"], "a": ["cat", "bird"]}
    out = []
    for _ in range(300):
        w, text = "the", []
        for _ in range(rnd.randint(0, 60)):
            text.append(w.upper() if rnd.random() < 0.05 else w)
            w = rnd.choice(after.get(w, ["the", "of", "sees", f"x{rnd.randint(0, 400)}", "the"]))
        out.append(" \n".join(text))
    return [*out, None, "", "Ünknown ünknown", "lone"]


def scored(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return lm.score_texts(df, **k).collect()


@pytest.mark.parametrize("block", [8_000_000, 2_000])
def test_counts_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    rows = list(enumerate(texts()))
    out = {zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    assert out == {True, False}
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in words_of(t))
    total, kinds = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in scored(spark, rows)}
    assert len(got) == len(rows)
    gain = 0.0
    for i, t in rows:
        w, r = words_of(t), got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), total)
        assert r.n_known == sum(counts[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 100  # the contexts help


def chain(c, d0, d1, sweeps=None, burn=None):
    """Mean tables of the counts c (contexts by words) by the sampler's own steps; without sweeps as many as it takes by its own rule."""
    u, w = np.nonzero(c)
    n = c[u, w]
    key = lm.mix64(u.astype(np.uint64) + np.uint64(77)) + w.astype(np.uint64)
    names = [np.arange(k, dtype=np.uint64) + np.uint64(1000 * (i + 1)) for i, k in enumerate(c.shape[::-1])]
    t, means = lm.guess(n), []
    totals = [t.sum()]
    rest = np.array([lm.STRENGTH + d0 * c.shape[1]])
    for sweep in range(1, (sweeps or 1000) + 1):
        p, g = (lm.auxiliary(np.full(len(x), kind), x, np.bincount(by, weights=t), d0, d1, sweep) for kind, (x, by) in enumerate(zip(names, (w, u))))
        log_a = np.log(d1) + np.log(g)[u] + np.log(p / (p.sum() + lm.gammas(rest, np.zeros(1, dtype=np.uint64), sweep)))[w]
        t = np.where(n > 1, lm.tables(n, log_a, d1, lm.uniform(key, sweep)), 1)
        means.append(np.where(n > 1, lm.tables(n, log_a, d1, None), 1))
        totals.append(t.sum())
        if not sweeps and lm.settled(totals[:-1]):
            return np.mean(means[-lm.SAMPLES :], axis=0)
    return np.mean(means[burn:], axis=0)


def ways(n, d):
    s = [[0.0] * (n + 2) for _ in range(n + 1)]
    s[1][1] = 1.0
    for i in range(1, n):
        for t in range(1, i + 2):
            s[i + 1][t] = s[i][t - 1] + (i - d * t) * s[i][t]
    return s[n]


@pytest.mark.parametrize("counts", [[[3]], [[4, 1], [2, 3]], [[6, 2, 1], [0, 5, 3]], [[12, 3]]])
def test_seating_follows_its_posterior(counts):
    """Mean tables of whole small models against the enumerated posterior."""
    c, d0, d1 = np.array(counts), 0.3, 0.6
    u, w = np.nonzero(c)
    n = c[u, w]
    total, mean = 0.0, np.zeros(len(n))
    for t in itertools.product(*(range(1, m + 1) for m in n)):
        t_u, t_w = np.bincount(u, weights=t), np.bincount(w, weights=t)
        log = sum(math.log(lm.STRENGTH + i * d1) for x in t_u for i in range(1, int(x)))
        log += sum(math.log(j - d0) for x in t_w for j in range(1, int(x))) - sum(math.log(lm.STRENGTH + k) for k in range(int(sum(t))))
        weight = math.exp(log) * math.prod(ways(int(m), d1)[x] for m, x in zip(n, t))
        total, mean = total + weight, mean + weight * np.array(t)
    assert np.allclose(chain(c, d0, d1, 12_000, 100), mean / total, rtol=0.02)


@pytest.mark.parametrize("related", [False, True])
def test_a_few_sweeps_are_enough(related):
    """The production rule gives the sums of a long chain: for unrelated words, and for ones that follow few contexts."""
    rng = np.random.default_rng(5)
    c = np.zeros((2000, 2000), dtype=int)
    u, w = np.minimum(rng.zipf(1.4, (2, 120_000)), 2000) - 1
    np.add.at(c, (u, (u * 7 + rng.geometric(0.05, len(u))) % 2000 if related else w), 1)
    c = c[:, c.sum(axis=0) > 0]
    n = c[c > 0]
    d1 = lm._discount((n == 1).sum(), (n == 2).sum())
    few, many = chain(c, 0.6, d1), chain(c, 0.6, d1, 100, 50)
    assert math.isclose(few.sum(), many.sum(), rel_tol=0.01)
    for side in np.nonzero(c):
        a, b = np.bincount(side, weights=few), np.bincount(side, weights=many)
        assert (abs(a - b)).sum() < 0.05 * b.sum()


def test_sums_to_one():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 9, (3, 50))
    c = c[:, c.sum(axis=0) > 0]
    d0, d1 = 0.4, 0.6
    u, w = np.nonzero(c)
    t = chain(c, d0, d1, 12, 4)
    m = lm.Model(int(c.sum()), c.shape[1], d0, d1, t.sum(), (0, 0.0))
    p = (np.bincount(w, weights=t) - d0) / (lm.STRENGTH + m.tables)
    for x in range(3):
        own = (c[u, w] - d1 * t)[u == x].sum()
        back = lm.STRENGTH + d1 * t[u == x].sum()
        assert math.isclose((own + back * (p.sum() + m.unknown())) / (lm.STRENGTH + c[x].sum()), 1.0, rel_tol=1e-9)


def test_gammas():
    key = np.arange(40_000, dtype=np.uint64)
    for shape in (0.2, 0.7, 1.0, 3.5, 400.0):
        x = lm.gammas(np.full(len(key), shape), key, 9)
        assert math.isclose(x.mean(), shape, rel_tol=5 / math.sqrt(shape * len(key)))
        assert math.isclose(x.var(), shape, rel_tol=0.1)


def seated_one_by_one(train, texts, d0, d1, sweeps, burn):
    """Log10 probabilities of texts by plain seating of one customer after the other."""
    rnd = random.Random(6)
    pairs = [(a, b) for t in train for a, b in zip(["\0start", *t], t)]
    V, s = len({b for _, b in pairs}), lm.STRENGTH
    rooms, t_u, t_w, c_u = defaultdict(list), Counter(), Counter(), Counter(a for a, _ in pairs)

    def root(w):
        return (t_w[w] - d0) / (s + T) if t_w[w] else (s + d0 * V) / (s + T)

    def sit(a, b):
        nonlocal T
        room = rooms[a, b]
        # the parent's base measure never draws a word twice: a word without tables opens one there
        new = (s + d1 * t_u[a]) * ((t_w[b] - d0) / (s + T) if t_w[b] else 1.0)
        x = rnd.random() * (sum(room) - d1 * len(room) + new)
        for i, k in enumerate(room):
            x -= k - d1
            if x < 0:
                room[i] += 1
                return
        room.append(1)
        t_u[a] += 1
        t_w[b] += 1
        T += 1

    T, score = 0, Counter()
    for a, b in pairs:
        sit(a, b)
    for sweep in range(sweeps):
        for a, b in pairs:
            room = rooms[a, b]
            x = rnd.random() * sum(room)
            i = next(i for i, k in enumerate(itertools.accumulate(room)) if x < k)
            room[i] -= 1
            if not room[i]:
                room.pop(i)
                t_u[a] -= 1
                t_w[b] -= 1
                T -= 1
            sit(a, b)
        if sweep >= burn:
            for k, t in texts.items():
                for a, b in zip(["\0start", *t], t):
                    score[k, a, b] += ((sum(rooms[a, b]) - d1 * len(rooms[a, b]) if (a, b) in rooms else 0) + (s + d1 * t_u[a]) * root(b)) / (s + c_u[a])
    return {k: sum(math.log10(score[k, a, b] / list(zip(["\0start", *t], t)).count((a, b)) / (sweeps - burn)) for a, b in zip(["\0start", *t], t)) for k, t in texts.items()}


def test_scores_against_plain_seating(spark):
    """A model this small mixes slowly: both run more sweeps than a corpus needs (the test above)."""
    rows = list(enumerate(texts()[:70]))
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    got = {r.doc_id: r.score for r in scored(spark, rows, burn=12, samples=8)}
    train = [words_of(t) for i, t in rows if not out[i]]
    n = Counter((a, b) for t in train for a, b in zip(["\0start", *t], t))
    kinds = Counter(b for _, b in n)
    found = Counter(n.values()), Counter(kinds.values())
    d1, d0 = (lm._discount(f[1], f[2]) for f in found)
    want = seated_one_by_one(train, {i: words_of(t) for i, t in rows}, d0, d1, 300, 50)
    assert all(math.isclose(got[i], want[i], rel_tol=0.02, abs_tol=0.05) for i, _ in rows), [(got[i], want[i]) for i, _ in rows]
    assert math.isclose(sum(got.values()), sum(want.values()), rel_tol=0.005)


def test_empty(spark):
    assert scored(spark, []) == []
    r = scored(spark, [(9, None)])[0]
    assert (r.n_tokens, r.train_tokens, r.held_out) == (1, 0 if r.held_out else 1, zlib.crc32(b"9") % 7 == 2)


@pytest.mark.parametrize(("n", "log_a"), [(3, 0.0), (60, -3.0), (1024, 1.0), (1500, 0.5), (6000, 4.0), (6000, -6.0)])
def test_tables_of_large_counts(n, log_a):
    """Mean and drawn tables against the enumerated conditional, whose weights come from the plain recursion."""
    d, most = 0.6, min(n, 2500)
    t = np.arange(1, most + 1)
    s = np.full(most + 1, -np.inf)
    s[1] = 0.0
    for i in range(1, n):
        with np.errstate(divide="ignore"):
            s[1:] = np.logaddexp(s[:-1], np.log(np.maximum(i - d * t, 0)) + s[1:])
    p = s[1:] + log_a * t
    p = np.exp(p - p.max()) / np.exp(p - p.max()).sum()
    assert p[-1] < 1e-9 or most == n
    mean, sd = (p * t).sum(), math.sqrt((p * t * t).sum() - (p * t).sum() ** 2)
    assert math.isclose(lm.tables(np.array([n]), np.array([log_a]), d, None)[0], mean, rel_tol=2e-3)
    k = 4000
    got = lm.tables(np.full(k, n), np.full(k, log_a), d, lm.uniform(np.arange(k, dtype=np.uint64), 1))
    assert abs(got.mean() - mean) < 5 * sd / math.sqrt(k) + 1e-3 * mean, (got.mean(), mean, sd)
    assert abs(got.std() - sd) < 0.1 * sd + 0.01


@pytest.mark.parametrize("block", [8_000_000, 2_000])
def test_rare_words_are_contexts(spark, monkeypatch, block):
    """A word that follows a rare word always is likelier there than after another rare word."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    rnd = random.Random(8)
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, " ".join(f"a{k} b{k}" for k in rnd.choices(range(200), k=20))) for i in train]
    same, other = (" ".join(f"a{k} b{(k + d) % 200}" for k in range(100)) for d in (0, 1))
    got = {r.doc_id: r.score for r in scored(spark, [*rows, (held[0], same), (held[1], other)])}
    assert got[held[0]] - got[held[1]] > 100 * math.log10(50)


def test_partitions_blocks_and_tiles_change_nothing(spark, monkeypatch):
    rows = list(enumerate(texts()))
    one = {r.doc_id: r.score for r in scored(spark, rows)}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(lm, "TILE_TOKENS", 900)  # words are split as well
    df = spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(7)
    two = {r.doc_id: r.score for r in lm.score_texts(df).collect()}
    assert all(math.isclose(one[i], two[i], rel_tol=1e-9) for i in one)


def test_odd_rows(spark):
    """Repeated rows, null ids, a very long text, and other columns whose names clash."""
    long = " ".join(f"w{i % 977} the" for i in range(150_000))
    rows = [(1, "a b a b", 1, "x"), (1, "a b a b", 1, "x"), (None, "c d", 2, "y"), (None, None, 3, None), (2, long, 4, "z"), (9, "a b", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block bigint, n string")
    got = lm.score_texts(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (0, 3), (1, 5), (1, 5), (2, 300_001), (9, 3)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and all(math.isfinite(r.score) for r in got)
    assert set(got[0].asDict()) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
