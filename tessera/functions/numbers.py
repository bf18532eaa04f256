"""Spoken forms of written numbers: cardinals, years, decades, ranges, decimals."""

from __future__ import annotations

import re

# English number names.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = [(10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (10**3, "thousand")]

#: A comma belongs to a number only before three digits, so a comma that ends a clause stays.
WRITTEN = re.compile(r"(?P<a>\d+(?:,\d{3}(?!\d))*)(?:(?P<dash>[–-])(?P<b>\d+(?:,\d{3}(?!\d))*))?(?:\.(?P<frac>\d+))?(?P<s>s(?![^\W\d_]))?")


def two_digits(n: int) -> str:
    if n < 20:
        return UNITS[n]
    word = TENS[n // 10 - 2]
    return f"{word}-{UNITS[n % 10]}" if n % 10 else word


def cardinal(n: int) -> str:
    """British reading: "and" before the last two digits wherever something stands before them."""
    for scale, name in SCALES:
        if n >= scale:
            rest = n % scale
            joint = " and " if 0 < rest < 100 else " "
            return f"{cardinal(n // scale)} {name}" + (joint + cardinal(rest) if rest else "")
    if n >= 100:
        return f"{UNITS[n // 100]} hundred" + (f" and {two_digits(n % 100)}" if n % 100 else "")
    return two_digits(n)


def year(n: int) -> str:
    """1001 to 2099 in pairs of digits; anything else, and 1000, as a cardinal."""
    if n == 1000 or not 1000 <= n <= 2099:
        return cardinal(n)
    century, rest = two_digits(n // 100), n % 100
    if rest == 0:
        return f"{century} hundred"
    return f"{century} oh {UNITS[rest]}" if rest < 10 else f"{century} {two_digits(rest)}"


def plural(words: str) -> str:
    """Plural of the last word of a reading (which only ends in a consonant's y or a regular ending)."""
    return re.sub(r"(?<=[^aeiou])y$", "ie", words) + "s"


def _plain(digits: str) -> int:
    return int(digits.replace(",", ""))


def _reading(m: re.Match) -> str:
    a, b, frac, s = m["a"], m["b"], m["frac"], m["s"]
    after = " point " + " ".join(UNITS[int(d)] for d in frac) if frac else ""
    if b:
        first = _plain(a)
        # an elided end of a range takes its missing leading digits from the start
        last = int(str(first)[: len(str(first)) - len(b)] + b.replace(",", "")) if len(b) < len(a) and "," not in a + b else _plain(b)
        return f"{year(first)} to {cardinal(last) + after if frac else year(last)}" + (s or "")
    if frac:
        return cardinal(_plain(a)) + after + (s or "")
    return plural(year(_plain(a))) if s else year(_plain(a))


def spell_numbers(text: str) -> str:
    return WRITTEN.sub(_reading, text)
