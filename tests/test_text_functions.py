"""Numbers, typography, sentences, packing, tokens and speak-time rewrites."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers, speech, text, tokens

EIGHT = "a b c d e f g h"


@pytest.mark.parametrize("n,said", [(1405, "fourteen oh five"), (1970, "nineteen seventy"), (1900, "nineteen hundred"), (1005, "ten oh five"), (1000, "one thousand")])
def test_years(n, said):
    assert numbers.year(n) == said


@pytest.mark.parametrize(
    "written,said",
    [
        ("1332-1406", "thirteen thirty-two to fourteen oh six"),
        ("1945-89", "nineteen forty-five to nineteen eighty-nine"),
        ("1330s", "thirteen thirties"),
        ("400s", "four hundreds"),
        ("1.3", "one point three"),
        ("600,000", "six hundred thousand"),
        ("1405, he", "fourteen oh five, he"),
        ("1-2.5", "one to two point five"),
        ("1,500,000", "one million five hundred thousand"),
        ("350ships", "three hundred and fiftyships"),
    ],
)
def test_written_numbers(written, said):
    assert numbers.spell_numbers(written) == said


def test_cardinals():
    assert numbers.cardinal(0) == "zero" and numbers.cardinal(1001) == "one thousand and one"
    assert numbers.cardinal(1_501_999) == "one million five hundred and one thousand nine hundred and ninety-nine"


def test_sentences_and_clauses():
    line = "Dr. Smith left. He returned at 3.5 p.m. quietly."
    assert [line[a:b] for a, b in text.sentence_bounds(line)] == ["Dr. Smith left.", "He returned at 3.5 p.m. quietly."]
    assert list(text.sentence_bounds("")) == [] and list(text.sentence_bounds("  no end ")) == [(2, 9)]
    for mark in (":", ";", " —"):
        assert len(text.clause_cuts(f"{EIGHT}{mark} {EIGHT}")) == 1
    assert not text.clause_cuts(f"{EIGHT}, {EIGHT}") and not text.clause_cuts(f"a b c: {EIGHT}")
    whole = f"{EIGHT}; {EIGHT} (x), {EIGHT}."
    assert "".join(whole[a:b] for a, b in text.clause_bounds(whole)) == whole


def test_packing(spark):
    assert text.pack([2, 3, 2], 70, 5) == [0, 0, 1] and text.pack([6], 70, 3) == [0]
    df = spark.createDataFrame([([40, 30, 30, 90, 1, 84, 2],), ([],)], "n array<int>")
    got = [r.g for r in df.select(text.group_numbers(F.col("n")).alias("g")).collect()]
    assert got == [text.pack([40, 30, 30, 90, 1, 84, 2]), []]


def test_typography(spark):
    cases = {"a - b": "a, b", "a -- b": "a, b", "'global'": "global", "Tamerlane's": "Tamerlane's", "“x”  y\n\tz": "x y z", "rock ’n’ roll": "rock n roll", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", text.typography(F.col("t")).alias("o")).collect()} == cases
    row = df.where("t is null").select(text.unspeakable(F.col("t")).alias("u")).first()
    assert row.u is True


@pytest.mark.parametrize(
    "said,want",
    [
        ("fourteen oh five", ["1405"]), ("twenty-one", ["21"]), ("fifty years", ["50", "years"]), ("fourteen hundred", ["1400"]),
        ("eight hundred and forty-three", ["843"]), ("four hundreds", ["400s"]), ("400s", ["400s"]), ("six hundred thousand", ["600000"]),
        ("two thousand five hundred", ["2500"]), ("Río de la Plata", ["rio", "de", "la", "plata"]), ("grâce", ["grace"]), ("São Paulo", ["sao", "paulo"]),
        ("thirteen thirties", ["1330s"]), ("1330's", ["1330s"]), ("forties", ["40s"]), ("the twenty-first", ["the", "21st"]), ("colonized", ["colonised"]),
        ("1.5", ["1", "point", "5"]), ("10-20", ["10", "to", "20"]), (None, []),
    ],
)
def test_tokens(said, want):
    assert tokens.tokenize(said) == want


def test_numbers_kept_apart():
    assert tokens.tokenize("fourteen hundred one") != ["1401"] and tokens.tokenize("twenty hundred") != ["2000"]
    assert tokens.tokenize("eight hundred forty-three") != ["843"] and tokens.tokenize("two thousand fifty") != ["2050"]
    both = tokens.readings("some one hundred and fifty thousand men")
    assert len(both) == 2 and ["150000" in r for r in both].count(True) == 1 and all("80000" not in r for r in both)


@pytest.mark.parametrize(
    "written,said",
    [
        ("Abbas I, king", "Abbas the First, king"), ("World War II", "World War Two"), ("Thus I have", "Thus I have"), ("Elizabeth I constructed", "Elizabeth the First constructed"),
        ("three hundred and fiftyships", "three hundred and fifty ships"), ("c.seventeen fifty and", "circa seventeen fifty and"), ("c. eighteen seventy", "circa eighteen seventy"),
        ("the c. end", "the c. end"), ("seventies hundreds fourth tenant thirty-ninea", "seventies hundreds fourth tenant thirty-nine a"), ("entrepô t", "entrepôt"),
    ],
)
def test_speech(written, said):
    assert speech.speak(written) == said


def test_columns(spark):
    df = spark.createDataFrame([("In 1405 he left. Abbas I, too.",), (None,)], "t string")
    row = df.select(text.number_words("t").alias("n"), tokens.tokens_of("t").alias("k"), speech.speak_text("t").alias("s"), text.sentence_spans("t").alias("p"), text.clause_units("t").alias("u"), tokens.readings_of("t").alias("r")).collect()
    assert row[0].n == "In fourteen oh five he left. Abbas I, too." and row[0].s.startswith("In 1405 he left. Abbas the First,") and len(row[0].p) == 2
    assert row[1].n is None and row[1].k == [] and row[1].p == []


def test_sentences_keep_figures_that_equal_their_place(spark):
    line = "End. 12 men. 2 x 2. 4133 3. 45"
    got = spark.createDataFrame([(line,)], "t string").select(text.sentences_sql(F.col("t")).alias("s")).first().s
    assert got == ["End.", "12 men.", "2 x 2.", "4133 3.", "45"]


def test_a_part_of_a_batch_is_python_objects_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from tessera.functions import udf

    class Batch:
        seen = []

        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            return Batch(self.values[at : at + n])

        def to_pylist(self):
            self.seen.append(len(self.values))
            return self.values

    made = []
    monkeypatch.setattr(udf, "arrow_udf", lambda f, kind: made.append(f) or (lambda *c: None))
    udf.mapped("array<string>")(lambda t: [t, t])(F.lit(1))
    assert made[0](Batch(["a"] * 1000)).to_pylist() == [["a", "a"]] * 1000 and max(Batch.seen) <= udf.PART
    assert made[0](pa.array([], pa.string())).to_pylist() == []
