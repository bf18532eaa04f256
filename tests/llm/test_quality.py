"""Operator 1 against a plain count, its verdicts, and filters on them."""

from __future__ import annotations

import random
import re
import time

from tessera.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_measures(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["the", "of", "a", "ünïcode", "中文", "b|c", "X", "**", "end."])
    texts = ["".join(word() + rnd.choice([" ", " ", "  ", "\n", "\t", " \x0b", "\r\n"]) for _ in range(rnd.randint(0, 90))) for _ in range(120)]
    texts += [None, "", " ", "\n\n", "a b c", "a b c a b c", "x y z x y z x", "same line\nsame line\n same line", "w " * 30000, "1 2 3 1 2", "   "]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id int, text string, kept boolean")
    for r in quality.apply_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdicts_and_filters(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    good = f"The start of it.\n{say(80)} and the end."
    rows = [(1, good), (2, good.upper()), (3, re.sub(" ", " | ", good)), (4, say(80)), (5, "\n".join([good, *["the same line of text"] * 3, *["the other line of it"] * 3])), (6, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    start = time.time()
    got = {r.doc_id: r.rejected_by for r in quality.apply_rules(df).where("not kept").select("doc_id", "rejected_by").collect()}
    assert time.time() - start < 60  # a filter on a verdict must not explode the plan
    assert got == {2: ["upper_case", "stop_words"], 3: ["symbols"], 4: ["stop_words"], 5: ["repeated_lines"], 6: ["stop_words"]}
    only = quality.apply_rules(df, rules=()).where("kept").count()
    assert only == 5


def test_empty(spark):
    assert quality.apply_rules(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_odd_rows(spark):
    """Repeated rows, null ids and columns whose names clash: one row each, judged alike, the columns replaced."""
    text = "The start of it and " + " ".join(f"w{i % 71}" for i in range(90)) + " to the end."
    df = spark.createDataFrame([(1, text, "a", 1), (1, text, "a", 1), (None, text, None, None), (None, None, "b", 2)], "doc_id int, text string, n_words string, extra int")
    got = quality.apply_rules(df).collect()
    assert len(got) == 4 and sorted(r.n_words for r in got) == [0, 98, 98, 98] and {r.kept for r in got if r.n_words} == {True}
    assert sorted((r.extra or 0) for r in got) == [0, 1, 1, 2]
