"""Speak-time rewrites: text defects, glued numbers, circa, and numerals after names."""

from __future__ import annotations

import re
from functools import reduce

from tessera.functions.numbers import TENS, UNITS
from tessera.functions.udf import mapped

# Known defects of a source text and their repair.
REPAIRS = {"entrepô t": "entrepôt", "entrepoô t": "entrepôt"}
# Numerals read as ordinals after names, as cardinals after these words; words before the pronoun.
NUMERALS = {n: i + 1 for i, n in enumerate("I II III IV V VI VII VIII IX X".split())}
ORDINALS = "First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth".split()
COUNTED = {"War", "Part", "Chapter", "Volume", "Book", "Act"}
BEFORE_PRONOUN = {"Thus"}
DECADES = {re.sub("y$", "ies", t) for t in TENS}

_NUMBER = set(UNITS) | set(TENS) | {"hundred", "thousand"}
_any = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
#: Number words that no ordinary word begins with.
_HEAD = _any(_NUMBER - {"one", "two", "six", "ten", "zero"})
#: What glued number words are before more letters; plurals, ordinals and decades are words of their own.
_REST = r"(?!(?:s|st|nd|rd|th)(?![a-z]))[a-z]++"
_GLUED = re.compile(rf"(?:(?!(?:{_any(DECADES)})(?![a-z]))(?:(?P<first>(?:{_HEAD})-(?>{_HEAD}))(?P<tail>{_REST})|(?P<head>(?>{_HEAD}))(?P<rest>{_REST})(?!-[a-z])))|[a-z]++(?:-[a-z]++)?", re.I)
_CIRCA = re.compile(rf"\bc\. ?((?:(?:{_any(_NUMBER | {'oh'})})(?![A-Za-z]) ?)+)", re.I)
_NUMERAL = re.compile(rf"\b(?:(?:{_any(BEFORE_PRONOUN)})\s+I\b(?![.,;:])|([A-Z][a-zA-Z]*)\s+({_any(NUMERALS)})\b)")
#: How numerals are read after a name: counted things have cardinals.
_READ = {True: {r: UNITS[n].capitalize() for r, n in NUMERALS.items()}, False: {r: f"the {ORDINALS[n - 1]}" for r, n in NUMERALS.items()}}

#: The rewrites in their order: a pattern, and what becomes of a match.
RULES = (
    (re.compile(_any(REPAIRS)), lambda m: REPAIRS[m[0]]),
    (_GLUED, lambda m: " ".join(filter(None, (m["first"] or m["head"], m["tail"] or m["rest"]))) or m[0]),
    (_CIRCA, lambda m: f"circa {m[1]}"),
    (_NUMERAL, lambda m: f"{m[1]} {_READ[m[1] in COUNTED][m[2]]}" if m[1] else m[0]),
)


def speak(text: str) -> str:
    return reduce(lambda t, rule: rule[0].sub(rule[1], t), RULES, text)


def split_glued(token: str) -> str:
    return _GLUED.sub(RULES[1][1], token)


@mapped("string")
def speak_text(text):
    return None if text is None else speak(text)
