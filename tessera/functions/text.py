"""Typography, word counts, sentences, clauses and greedy packing."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numbers import spell_numbers
from tessera.functions.udf import mapped

#: A word: letters, digits, underscores, and apostrophes after the first of them.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
_PY_WORD = re.compile(r"\w[\w']*")

# Abbreviations that don't end a sentence.
ABBREVIATIONS = {"a.m.", "c.", "cf.", "dr.", "e.g.", "etc.", "fig.", "i.e.", "mr.", "mrs.", "ms.", "no.", "nos.", "p.", "p.m.", "pp.", "prof.", "st.", "vol.", "vs."}
# Packing and clause limits in words.
TARGET_WORDS, MOST_WORDS, CLAUSE_WORDS = 70, 85, 8

SPAN = "struct<start:int,end:int,text:string,words:int>"


def typography(text: Column) -> Column:
    """Spaces collapsed, spaced dashes to commas, double quotes dropped, apostrophes kept between letters only."""
    out = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"\s+[–—-]{1,2}\s+", ", ")
    out = F.regexp_replace(F.translate(out, "‘’", "''"), '[“”"]', "")
    out = F.regexp_replace(out, r"(?<!\p{L})'|'(?!\p{L})", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def spaced_words(text: Column) -> Column:
    """The other word counter: runs of non-space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def unspeakable(text: Column) -> Column:
    """No Latin letter at all; null counts as none."""
    return ~F.coalesce(text.rlike("[A-Za-z]"), F.lit(False))


@mapped("string")
def number_words(text):
    return None if text is None else spell_numbers(text)


_LOWER_ABBREVIATIONS = "|".join(re.escape(a[:-1]) for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
#: An end of a sentence of a normalised line, with the space after it: no abbreviation, no initials, no small letter next.
#: What stands before a mark is looked at only there.
SENTENCE_END = (
    rf"((?:\.(?<![.!?]\.)(?<!(?:^|\s)(?i:{_LOWER_ABBREVIATIONS})\.)(?<!(?:^|\s)(?:[A-Z]\.){{1,31}})|[!?](?<![.!?][!?]))[.!?]*[)\]]?)\s+(?!\p{{Ll}})"
)


def sentences_sql(text: Column) -> Column:
    """Array of sentences of a normalised line by the full rule, as expressions only."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")  # a bare F.trim would take the index as what to trim


def count_words(text: str) -> int:
    return len(_PY_WORD.findall(text))


# A word that ends in a mark, initials, the first character after a gap, and a gap.
_ENDING = re.compile(r"(?<!\S)\S++(?:(?<=[.!?])|(?<=[.!?][)\]]))")
_INITIALS = re.compile(r"(?:[A-Z]\.)+")
_AFTER = re.compile(r"\s*(.?)", re.S)
_GAP = re.compile(r"\s*")


def _ends_here(m: re.Match) -> bool:
    """Whether a word with a mark ends a sentence: not an abbreviation or initials, nor before a small letter."""
    marked = m[0][:-1] if m[0][-1] in ")]" else m[0]
    word = marked.rstrip(".!?")
    short = marked[len(word)] == "." and (f"{word}.".lower() in ABBREVIATIONS or _INITIALS.fullmatch(f"{word}."))
    return not short and not _AFTER.match(m.string, m.end())[1].islower()


def sentence_bounds(text: str) -> Iterator[tuple[int, int]]:
    """Exact slices of the full rule: candidates are words with an end mark, and those that end a sentence cut the text."""
    cuts = [m.end() for m in _ENDING.finditer(text) if _ends_here(m)]
    edges = [0, *cuts, len(text)]
    for a, b in zip(edges, edges[1:]):
        if part := text[a:b].strip():
            yield text.index(part[0], a), b


_CUT = re.compile(r"[:;—]|\),")


def clause_cuts(text: str) -> list[tuple[int, str, int, int]]:
    """(offset after the mark, mark, words left, words right) of cuts with enough words of the sentence on both sides."""
    found, out = list(_CUT.finditer(text)), []
    starts = [w.start() for w in _PY_WORD.finditer(text)] if found else []
    for m in found:
        left = bisect_left(starts, m.end())  # no word goes across a mark
        if min(left, len(starts) - left) >= CLAUSE_WORDS:
            out.append((m.end(), m[0], left, len(starts) - left))
    return out


def clause_bounds(text: str) -> list[tuple[int, int]]:
    """Contiguous slices; white space after a cut stays with the clause before it."""
    ends = [_GAP.match(text, at).end() for at, *_ in clause_cuts(text)]
    edges = [0, *ends, len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def units(text: str) -> list[dict]:
    """Clauses of all sentences with offsets into text."""
    out = []
    for i, (a, b) in enumerate(sentence_bounds(text)):
        for k, (x, y) in enumerate(clause_bounds(text[a:b])):
            out.append({"start": a + x, "end": a + y, "text": text[a + x : a + y], "words": count_words(text[a + x : a + y]), "sentence": i, "clause": k})
    return out


def pack(sizes: list[int], target: int = TARGET_WORDS, most: int = MOST_WORDS) -> list[int]:
    """Group number of each unit: a group closes at the target, or before it would pass the most."""
    out, group, held = [], -1, 0
    for n in sizes:
        if group < 0 or held >= target or held + n > most:
            group, held = group + 1, 0
        held += n
        out.append(group)
    return out


def packed(text: str) -> list[dict]:
    """Groups of clauses, with offsets into text, words, and the sentences from s0 to before s1."""
    found = units(text)
    groups = groupby(zip(pack([u["words"] for u in found]), found), key=lambda x: x[0])
    runs = [[u for _, u in run] for _, run in groups]
    return [{"start": r[0]["start"], "end": r[-1]["end"], "words": sum(u["words"] for u in r), "s0": r[0]["sentence"], "s1": r[-1]["sentence"] + 1, "clauses": len(r)} for r in runs]


UNIT = "struct<start:int,end:int,text:string,words:int,sentence:int,clause:int>"


@mapped(f"array<{UNIT}>")
def clause_units(text):
    return units(text or "")


@mapped("array<struct<start:int,end:int,words:int,s0:int,s1:int,clauses:bigint>>")
def packed_units(text):
    return packed(text or "")


@mapped(f"array<{SPAN}>")
def sentence_spans(text):
    return [{"start": a, "end": b, "text": text[a:b], "words": count_words(text[a:b])} for a, b in sentence_bounds(text or "")]


def group_numbers(sizes: Column, target: int = TARGET_WORDS, most: int = MOST_WORDS) -> Column:
    """pack() as a fold over an array of word counts: array of group numbers."""
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["g"] < 0) | (acc["held"] >= target) | (acc["held"] + n > most)
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(g.alias("g"), F.when(new, n).otherwise(acc["held"] + n).alias("held"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])
