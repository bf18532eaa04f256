"""Operator 3: coverage, format, gender, script, coreference and distinctness."""

from __future__ import annotations

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import pii

TEXTS = [
    "Write to er.49@mail9.example.com or er.50@mail9.example.com, or call +1 (551) 555-0826.",
    "Card 4539578763621486 and 4785380592391139; host 152.143.123.131 is up. Version 3.11.2, price 1,299.00 in 2024.",
    "Anna Berg met Mr. Smith; Anna left, John Smith stayed. Ольга Иванова тоже.",
    "Nothing personal here: 12 apples, line 4.5, www.example.com.",
    "er.49@mail9.example.com,er.49@mail9.example.com",
    None,
    "",
    "(212) 555-0199 and 212-555-0198; SSN 123-45-6789; DE89 3704 0044 0532 0130 00; 4539 5787 6362 1486",
    "müller.äß@straße.example.org почта@пример.com",
    "x" * 60000 + " 10.0.0.1 " + "y" * 60000,
]


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, value string").repartition(3)
    got = pii.replace_personal_data(df, key)
    assert got.columns == ["doc_id", "text", "value", "n_entities"]
    rows = {r.doc_id: (r.text, r.n_entities) for r in got.collect()}
    return [rows[i] for i in range(len(texts))]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_replaces_and_keeps_shape(spark):
    out = run(spark, TEXTS)
    assert [n for _, n in out] == [3, 3, 8, 0, 2, 0, 0, 5, 2, 1]
    assert out[3][0] == TEXTS[3] and out[5][0] is None and out[6][0] == ""
    assert re.fullmatch(r"Write to [a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com or [a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com, or call \+1 \(\d{3}\) \d{3}-\d{4}\.", out[0][0])
    a, b = re.findall(r"\S+@[^\s,]+", out[0][0])
    assert a != b and a.split("@")[1] == b.split("@")[1]  # the same domain stays the same
    assert out[4][0] == f"{a},{a}"
    m = re.fullmatch(r"Card (4\d{15}) and (4\d{15}); host (\d+\.\d+\.\d+\.\d+) is up\. Version 3\.11\.2, price 1,299\.00 in 2024\.", out[1][0])
    assert luhn(m[1]) and all(1 <= int(o) <= 254 for o in m[3].split("."))
    m = re.fullmatch(r"(\w+) (\w+) met Mr\. (\w+); (\w+) left, (\w+) (\w+) stayed\. (\w+) (\w+) тоже\.", out[2][0])
    assert m[1] == m[4] and m[3] == m[6] and len({m[1], m[2], m[3], m[5], m[7]}) == 5
    assert m[1].endswith(("na", "lia", "tta", "nelle", "ssa", "ria")) and re.fullmatch("[А-Яа-я]+", m[7] + m[8])
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4} and \d{3}-\d{3}-\d{4}; SSN \d{3}-\d\d-\d{4}; D[A-Z]\d\d( \d{4}){4} \d\d; 4\d{3}( \d{4}){3}", out[7][0])
    assert re.fullmatch(r"[a-z]+\.[a-z]{2}@[a-z]{6}\.[a-z]{7}\.org [а-я]{5}@[а-я]{6}\.com", out[8][0])
    assert len(out[9][0]) > 120000 and "10.0.0.1" not in out[9][0]
    for t, (o, n) in zip(TEXTS, out):  # no value survives
        for v in re.findall(r"\S+@\S+\w|\d{13,}|\d+\.\d+\.\d+\.\d+", t or ""):
            assert v not in o


def test_key_and_repeats(spark):
    assert run(spark, TEXTS) == run(spark, TEXTS) != run(spark, TEXTS, "other")


def test_distinct_surrogates(spark):
    """A small space forces clashes: all ten-thousand-odd short addresses still differ."""
    values = spark.createDataFrame([(f"{a}@{b}.com",) for a in "abcdefghijklmnop" for b in ["x", "y"]] + [(f"0.0.0.{i}",) for i in range(50)], "value string")
    got = pii.surrogates(values, "k").collect()
    assert len(got) == 82 == len({r.surrogate for r in got}) and not {r.value for r in got} & {r.surrogate for r in got}


def test_coreference(spark):
    """Possessives, bare surnames and capitals of a text's known persons; other names of other texts stay."""
    text = "Mr. Smith left. Smith's car stayed. I met Mr. Smith's wife and John Smith. Later Smith called; ANNA and Zhang Wei came with Anna Berg. Smithson didn't."
    (out, n), (other, m) = run(spark, [text, "A Smith is someone who works with iron."])
    s = re.match(r"Mr\. (\w+) left\.", out)[1]
    g = re.search(r"(\w+) Smith", text)[1]
    first, anna, berg = re.search(rf"and (\w+) {s}\. Later", out)[1], re.search(r"came with (\w+)", out)[1], re.search(r"with \w+ (\w+)\.", out)[1]
    assert g == "John" and out == f"Mr. {s} left. {s}'s car stayed. I met Mr. {s}'s wife and {first} {s}. Later {s} called; {anna.upper()} and Zhang Wei came with {anna} {berg}. Smithson didn't."
    assert len({s, first, anna, berg, "Smith", "John", "Anna", "Berg"}) == 8 and n == 9
    assert (other, m) == ("A Smith is someone who works with iron.", 0)


def test_against_brute_force(spark):
    """Every text put together again by a plain search with another engine, from the table of surrogates."""
    rnd = random.Random(3)
    parts = ["Anna", "Berg", "Mr. Smith", "Smith", "John O'Brien", "O'Brien's", "SMITH", "ANNA", "Otto Müller-Lang", "Müller-Lang", "a.b@c.org", "10.1.2.3", "+49 30 1234567", "4539 5787 6362 1486", "the", "house", "of", "Ольга Иванова", "Иванова", "ИВАНОВА", "\uffff", "Nothing", "12"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", " ", ". ", ", ", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    texts += [texts[0], texts[1], None, ""]
    entity, mention = regex.compile(java(pii.ENTITY)), regex.compile(java(f"{pii.ENTITY}|{pii.MENTION}"))
    values = sorted({m[0] for t in texts for m in entity.finditer(t or "")})
    table = {r.value: r.surrogate for r in pii.surrogates(spark.createDataFrame([(v,) for v in values], "value string"), "k").collect()}
    assert set(table) == set(values) and len(set(table.values())) == len(values) and not set(table.values()) & set(values)
    want = []
    for t in texts:
        own = {m[0] for m in entity.finditer(t or "")}
        count = 0

        def swap(m):
            nonlocal count
            v = m[0]
            name = v[:1].upper() + v[1:].lower()
            new = table[v] if v in own else table[name].upper() if v == v.upper() and name in own else None
            count += new is not None
            return v if new is None else new

        want.append((mention.sub(swap, t) if own else t, count))
    assert run(spark, texts) == want


def java(pattern):
    return pattern.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}")


def test_names_never_run_out(spark, monkeypatch):
    """Far more surnames than short made-up names: they grow until all are distinct."""
    monkeypatch.setattr(pii, "_LATIN", ["ba", "do"])
    monkeypatch.setattr(pii, "_ENDINGS", {k: {"latin": ["n"], "cyrillic": ["н"]} for k in pii._ENDINGS})
    values = spark.range(4000).select(F.concat(F.lit("X"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("value"))
    got = pii.surrogates(values, "k").collect()
    assert len(got) == 4000 == len({r.surrogate for r in got})
    with pytest.raises(ValueError):
        pii.surrogates(values, "")


def test_odd_rows(spark):
    """Repeated rows, null ids, and a column that has the name of the one added."""
    df = spark.createDataFrame([(1, "Mr. Smith", "a"), (1, "Mr. Smith", "a"), (None, "Mr. Smith", "b"), (None, None, None)], "doc_id bigint, text string, n_entities string")
    got = pii.replace_personal_data(df, "k")
    assert got.dtypes == [("doc_id", "bigint"), ("text", "string"), ("n_entities", "bigint")]
    rows = got.collect()
    assert len(rows) == 4 and len({r.text for r in rows}) == 2 and sum(r.n_entities for r in rows) == 3


def test_empty(spark):
    assert pii.replace_personal_data(spark.createDataFrame([], "doc_id bigint, text string"), "k").count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
