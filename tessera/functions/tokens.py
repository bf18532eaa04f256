"""Canonical tokens: numbers in any spelling become one form; two readings where English has two.

Merging is a chain of passes over the token list.  A pass is a rule that looks at the list from a
position and either gives (replacement, tokens used) or nothing; ``rewrite`` runs it left to right.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from tessera.functions.numbers import TENS, UNITS
from tessera.functions.udf import mapped

# Names of numbers, ordinals and decades.
NUMBER = {w: str(i) for i, w in enumerate(UNITS)} | {w: str(20 + 10 * i) for i, w in enumerate(TENS)}
ORDINAL = {w: i + 1 for i, w in enumerate("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split())} | {"thirtieth": 30}
ORDINAL |= {f"{t}{gap}{w}": base + n for t, base in (("twenty", 20), ("thirty", 30)) for w, n in list(ORDINAL.items())[:9] for gap in "- " if base + n <= 31}
DECADE = {re.sub("y$", "ies", t): str(20 + 10 * i) for i, t in enumerate(TENS)}

_FIRST = set("0123456789'")

Rule = Callable[[list[str], int], tuple[str, int] | None]


def rewrite(tokens: list[str], rule: Rule) -> list[str]:
    """Rules begin at figures, decades and apostrophes only."""
    out, i = [], 0
    while i < len(tokens):
        hit = rule(tokens, i) if tokens[i][:1] in _FIRST or tokens[i] in DECADE else None
        out.append(hit[0] if hit else tokens[i])
        i += hit[1] if hit else 1
    return out


def _at(tokens: list[str], i: int) -> str:
    return tokens[i] if i < len(tokens) else ""


def decade_pair(t: list[str], i: int):
    """thirteen thirties -> 1330s; 1330's -> 1330s."""
    if m := re.fullmatch(r"(1\d\d0)'?s", t[i]):
        return m[1] + "s", 1
    ten = _at(t, i + 1).removesuffix("'s")
    ten = DECADE.get(ten, ten)
    if re.fullmatch(r"1\d", t[i]) and re.fullmatch(r"[2-9]0", ten):
        return f"{t[i]}{ten}s", 2


def _hundreds(word: str, suffix: str) -> Rule:
    def rule(t: list[str], i: int):
        # not before another number, which would make it part of a longer one
        if _at(t, i + 1) == word and re.fullmatch(r"[1-9]|1\d", t[i]) and not _at(t, i + 2).isdigit():
            return f"{int(t[i]) * 100}{suffix}", 2

    return rule


century, hundreds_decade = _hundreds("hundred", ""), _hundreds("hundreds", "s")


def thousand(t: list[str], i: int):
    """N thousand, with round hundreds after it; any other number after it keeps them apart."""
    if not (t[i].isdigit() and _at(t, i + 1) == "thousand"):
        return None
    nxt = _at(t, i + 2)
    if not nxt.isdigit():
        return str(int(t[i]) * 1000), 2
    if 0 < int(nxt) < 1000 and int(nxt) % 100 == 0:
        return str(int(t[i]) * 1000 + int(nxt)), 3


def remainder(t: list[str], i: int):
    """A multiple of a hundred "and" one to ninety-nine."""
    low = _at(t, i + 2)
    if t[i].isdigit() and int(t[i]) and int(t[i]) % 100 == 0 and _at(t, i + 1) == "and" and low.isdigit() and 1 <= int(low) <= 99 and not _at(t, i + 3).isdigit():
        return str(int(t[i]) + int(low)), 3


def bare_decade(t: list[str], i: int):
    if t[i] in DECADE:
        return DECADE[t[i]] + "s", 1
    if m := re.fullmatch(r"'?([2-9]0)'?s", t[i]):
        return m[1] + "s", 1


PLAIN = (decade_pair, century, hundreds_decade, thousand, remainder, bare_decade)
COMPOUND = (decade_pair, century, hundreds_decade, remainder, thousand, bare_decade)

_EDGE_A, _EDGE_B = r"(?<![a-z0-9])", r"(?![a-z0-9])"
_ORDINALS = re.compile(_EDGE_A + "(" + "|".join(sorted(ORDINAL, key=len, reverse=True)) + ")" + _EDGE_B)
_TENS_UNIT = re.compile(rf"\b({'|'.join(TENS)})-({'|'.join(UNITS[1:10])})\b")
_ISE = re.compile(r"iz(?=(?:e|es|ed|ing|ation|ations|er|ers|able|ability)$)")


def ordinal(n: int) -> str:
    return f"{n}{'th' if n % 100 in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def fold(text: str) -> str:
    """Letters without their accents."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def pieces(text: str) -> list[str]:
    """Tokens before the merging passes; adjacent digit tokens are one."""
    t = fold(text.lower().replace("’", "'"))
    t = re.sub(_EDGE_A + r"(\d+)\.(\d+)" + _EDGE_B, r"\1 point \2", t)
    t = re.sub(_EDGE_A + r"(\d+)-(\d+)" + _EDGE_B, r"\1 to \2", t)
    t = _ORDINALS.sub(lambda m: ordinal(ORDINAL[m[1]]), t)
    t = _TENS_UNIT.sub(lambda m: str(int(NUMBER[m[1]]) + int(NUMBER[m[2]])), t)
    out: list[str] = []
    joins = False
    for w in re.sub(r"[^a-z0-9']+", " ", t).split():
        w = NUMBER.get(w) or ("0" if w == "oh" else _ISE.sub("is", w) if "iz" in w else w)
        if w.isdigit() and joins:
            out[-1] += w
        else:
            out.append(w)
        joins = w.isdigit()
    return out


def tokenize(text: str, passes=PLAIN) -> list[str]:
    out = pieces(text or "")
    if not any(w[0] in _FIRST or w in DECADE for w in out):
        return out
    for rule in passes:
        out = rewrite(out, rule)
    return out


@lru_cache(maxsize=1 << 16)
def _kept(text: str) -> tuple[str, ...]:
    return tuple(tokenize(text))


def tokens_of_word(text: str) -> tuple[str, ...]:
    """The plain reading of a word; those of words that come again are kept."""
    return _kept(text) if len(text) <= 40 else tuple(tokenize(text))


def readings(text: str) -> list[list[str]]:
    """The plain reading, and the one that adds a remainder before "thousand" if it differs."""
    first, second = tokenize(text), tokenize(text, COMPOUND)
    return [first] if first == second else [first, second]


@mapped("array<string>")
def tokens_of(text):
    return tokenize(text)


@mapped("array<array<string>>")
def readings_of(text):
    return readings(text or "")
