"""Operator 2 against the tokenizer's own library."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens
from tessera.llm.queries import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    return tokens.Counter(tokens.PieceModel.load(path)), library


EDGE = ["", " ", "   a", "hello  <s> world\n\nfoo▁bar \t x<0x0A>　é ﬁ ", "\x00a​ b", "▁▁", "a" * 3000, "the cat" * 500 + " ", "😀😀 ok", " lead", "trail ", " " * 120 + "x", "</s><unk>"]


def test_edges(both):
    counter, library = both
    assert counter.counts(EDGE) == [len(x) for x in library.encode(EDGE)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁abcthe\n1é😀ß中"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(both, text):
    counter, library = both
    assert counter.counts([text]) == [len(library.encode(text))]


def test_long_units_and_full_store(both, monkeypatch):
    counter, library = both
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcthe1-") for _ in range(rnd.randint(300, 1500))) for _ in range(20)]
    want = [len(x) for x in library.encode(texts)]
    assert counter.counts(texts) == want
    monkeypatch.setattr(tokens, "CACHE_UNITS", 1)
    assert counter.counts(texts) == want
    assert [counter.model.count_long("▁" + t) for t in texts[:5]] == want[:5]


def test_rows(spark, both):
    _, library = both
    rows = [(1, "hello world", 7), (1, "hello world", 7), (2, None, 7), (3, "", 7), (None, "é" * 5, 7), (4, "word " * 40000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = tokens.token_counts(df, tokenizer_path())
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens"] and dict(got.dtypes)["n_tokens"] == "bigint"
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert tokens.token_counts(df.limit(0), tokenizer_path()).count() == 0
