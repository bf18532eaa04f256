"""Operator 9: whole, partial, re-parameterised and inconsistent questions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.llm import leaks

QUESTION = "A farmer called Anna Berg sold 12 apples to her neighbour Otto for 3 dollars and later sold 12 more apples to the same Otto for 5 dollars."
SHORT = "seven little foxes jumped over"


def pairs(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    return {(r.doc_id, r.item_id) for r in leaks.leaked_pairs(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}


def test_templates(spark):
    swap = QUESTION.replace("Anna Berg", "Lena").replace("Otto", "Paul").replace("12", "40").replace("3 dollars", "8 euros").replace("5 dollars", "9 euros")
    broken = QUESTION.replace("the same Otto", "the same Paul").replace("12 more", "77 more")
    docs = [
        (1, f"Before it. {QUESTION} After it.", 0),
        (2, f"before it {swap} after", 0),
        (3, f"x {broken} y", 0),
        (4, " ".join(QUESTION.split()[:9]) + " and then nothing of that kind at all happened here", 0),
        (5, QUESTION.upper(), 0),
        (6, None, 0),
        (7, "", 0),
        (8, f"Once {SHORT} the hedge", 0),
        (None, QUESTION, 0),
        (9, f"{QUESTION} {swap}", 0),
        (1, f"Before it. {QUESTION} After it.", 0),
    ]
    items = [(10, QUESTION), (11, SHORT), (12, "too short"), (13, None)]
    got = pairs(spark, docs, items)
    # 3: a copy of which single values were changed; 5: in capitals; 4: less than SHARE of the question
    assert got == {(1, 10), (2, 10), (3, 10), (5, 10), (8, 11), (None, 10), (9, 10)}
    monkey = leaks.BROADCAST_WINDOWS
    try:
        leaks.BROADCAST_WINDOWS = 0
        assert pairs(spark, docs, items) == got
    finally:
        leaks.BROADCAST_WINDOWS = monkey
    d = spark.createDataFrame(docs, "doc_id bigint, text string, r1 int")
    kept = leaks.without_leaks(d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6, 7] and kept.columns == ["doc_id", "text", "r1"]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert pairs(spark, [(1, QUESTION, 0)], []) == set()
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaks.leaked_pairs(d, none).count() == 0


def test_passes_equal_raw_tokens(spark):
    """Tokens by passes over whole texts are those of the raw tokens, whose values the slots are."""
    rnd = random.Random(2)
    parts = ["Anna", "ANNA", "McDonald", "O'Brien", "Anna's", "Anna'S", "iPhone", "the", "it's", "’Tis", "'Otto", "5", "3.5.7kg", "12", "kg", "kgs", "KG", "Days", "$", "€", "%", "1,5", "a5kg", "5Anna", "Ünal", "ÉTÉ", "été", "\u0001", "\u0002", "-", ".", ",", "x", "Z", "日本", "ß"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "  ", "\n", "\u00a0", ". "]) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", leaks.raw_tokens(F.col("text")).alias("raw"), leaks.marked_figures(F.col("text")).alias("f"))
    for kind in (leaks.PLAIN, leaks.NAMED):
        for r in df.select("text", F.transform(leaks.template(F.col("raw"), kind), lambda x: x["t"]).alias("a"), leaks.template_tokens(F.col("f"), kind).alias("b")).collect():
            assert r.a == r.b, r


def test_marks_of_the_text_itself(spark):
    """Marks that a text holds become blanks, whichever it holds; other texts stay as they are."""
    texts = {None: "", "": "", "a b": "a b", "a\u0001b": "a b", "\u0002a": " a", "a\u0003": "a ", "\u0003a\u0001\u0002": " a  "}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", leaks._unmarked(F.col("text")).alias("out"))
    assert {r.text: r.out for r in df.collect()} == texts


def found(spark, text, item):
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = leaks.leaked_pairs(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    return (rows[0].matched_windows, rows[0].item_windows, rows[0].n_slots) if rows else None


def test_one_value_for_one_across_all_alignments(spark):
    """A word put in between makes a second alignment; there 4 would stand for 9 as well, which doesn't count."""
    item = "they gave 4 apples to the old man under the tall tree and 4 pears to the small child by the river"
    whole = found(spark, item, item)
    assert whole == (17, 17, 1)
    other = found(spark, item.replace("4", "7"), item)
    assert other == (17, 17, 1)
    text = item.replace("and 4 pears", "then and 9 pears")
    n, of, slots = found(spark, text, item)
    # twelve windows fit but for their values; those with the second 4 do not count
    assert of == 17 and slots == 1 and n <= 12
    with_4 = found(spark, item.replace("and 4 pears", "then and 4 pears"), item)
    assert with_4[0] > n


def test_slots_belong_to_their_tokens(spark):
    """A quantity before a name, names after units and at the start: values don't slip."""
    item = "for 3 days Anna said and then paid 5 dollars to Otto who gave 3 days of work and 5 dollars to Anna and Otto"
    changed = item.replace("Anna", "Lena").replace("Otto", "Karl").replace("3 days", "8 weeks").replace("5 dollars", "2 euros")
    whole = found(spark, item, item)
    assert whole[0] == whole[1] and found(spark, changed, item)[:2] == whole[:2]
    assert found(spark, f"after 3 days London was quiet. {item}", item)[:2] == whole[:2]
    assert found(spark, "Maria bought 7 lamps for her room", "Jonas bought 9 lamps for her room") is not None


def test_white_space_and_case(spark):
    item = "The trader Anna Berg of Port Said sold 12 kg of salt to Otto Lind in April"
    for text in (item.upper(), item.lower(), item.replace(" ", "\n"), item.replace(" ", "  "), item.replace(" ", "\u00a0")):
        n, of, _ = found(spark, text, item)
        assert n == of, text


def test_short_items(spark):
    """Items under LEAST tokens must be the whole text; those of four and five are windows of their own length."""
    assert found(spark, "Well, why not?", "Well why not") == (1, 1, 0) and found(spark, "oh well why not", "Well why not") is None
    assert found(spark, "one may ask why not go there", "why not go there") == (1, 1, 0)


def test_very_long_text(spark):
    filler = " ".join(f"w{i % 5003} of" for i in range(60_000))
    assert found(spark, f"{filler} {QUESTION} {filler}", QUESTION)[0] > 0 and found(spark, filler, QUESTION) is None


def test_long_runs(spark):
    """Runs of very many names, figures or both in one text (lists, tables) don't overflow the stack of the pattern engine."""
    runs = {
        "names": "Anna Berta\nCarla " * 20_000,
        "figures": "1,20:3/4." * 5_000 + "5",
        "quantities": "$" + "1,20:3/4." * 5_000 + "5 kg of it",
        "both": "Anna Berta 1.5 Carla 2 kg " * 20_000,
    }
    docs = [(k, f"{run} and {QUESTION} {run}", 0) for k, run in enumerate(runs.values())] + [(k + 10, run, 0) for k, run in enumerate(runs.values())]
    assert pairs(spark, docs, [(1, QUESTION)]) == {(k, 1) for k in range(len(runs))}


def test_sql(spark, tmp_path):
    """The query against its SQL on short items, names, units and repeated rows."""
    import duckdb

    docs = [(1, QUESTION), (1, QUESTION), (2, QUESTION.upper()), (3, QUESTION.replace("12 more", "77 more")), (4, "for 3 days Anna said: 5 % of it"), (5, "Why not go there"), (6, None), (None, f"x {SHORT} y {QUESTION.replace('Otto', 'Paul')}"), (7, "$5 and €6 5kg 5 kgs 7 % Anna's Otto Lind's")]
    items = [(10, QUESTION), (11, SHORT), (12, "why not go there"), (13, None), (14, "for 8 days Lena said: 6 % of it"), (15, "yes"), (16, "$7 and €8 5kg 5 kgs 7 % Lena's Karl Lind's")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, leaks.leaked_pairs(d, i).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.execute(f"WITH {leaks.leaks_sql()} SELECT DISTINCT doc_id, item_id, matched_windows, item_windows, n_slots FROM leaked").fetchall()
    assert got == sorted(want, key=str) and len(got) >= 7
