"""Personal data replaced by keyed surrogates (operator 3).

One pattern finds e-mail and network addresses, telephone, card and identity numbers, given names of
a gendered lexicon, and surnames after those or after a form of address.  Each distinct value gets
one surrogate, a keyed hash shaped like the value: letters of the same script and case, digits for
digits, the same separators, valid octets, a valid check digit where the value had one, a name of
the same gender.  The same value has the same surrogate in every text (given names and surnames
separately, so full and short mentions still refer to one person; mail domains likewise).  Within a
text, a name found once is replaced wherever it stands as a word: alone, before a possessive, or in
capitals, where the surrogate is in capitals too.

Distinctness is checked, not assumed: a candidate that another value has, or that is itself a value
of the corpus, is drawn again with the next salt until no clash is left; of several values with one
candidate the first in order keeps it.  Only the clashing ones are drawn and compared again, and made-up
names grow by a syllable with each draw, so there are enough for any number of values.  (So what a value
becomes may depend on the other values of the corpus.)  The tables hold distinct values only (counted
with map-side combination, so a value in a third of all texts costs a row a task), and surrogates go
back through joins keyed by value and by text, never through the driver or a broadcast of the table.

All texts are searched once; texts with entities once more, to put the surrogates in.  The key is
required: who has it can recompute surrogates from guessed values.

Everything is DataFrame functions.  Rows: null texts stay null, empty ones empty, both with no
entities; texts without entities are unchanged to the byte; repeated rows get equal results; very
long texts are read whole; null ids and other columns pass by, and clashing ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, dealt_anew, text_key

# Given names by gender, and forms of address.
MALE = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Joshua Kevin Brian George Edward Hans Klaus Jürgen Wolfgang Stefan Andreas Matthias Otto Heinrich Friedrich Jean Pierre Michel Philippe François Jacques Laurent Olivier Antoine Étienne José Carlos Juan Luis Javier Miguel Pedro Diego Fernando Alejandro Иван Сергей Дмитрий Алексей Николай Андрей"
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Anna Ursula Helga Ingrid Petra Sabine Monika Claudia Katharina Johanna Marie Nathalie Isabelle Sylvie Catherine Françoise Monique Céline Hélène Chloé María Carmen Ana Isabel Lucía Dolores Pilar Teresa Rosa Elena Ольга Елена Наталья Татьяна Ирина Светлана"
ADDRESS = "Mr. Mr Mrs. Mrs Ms. Ms Miss Dr. Herr Frau Monsieur Madame Mme Señor Señora Sr. Sra."

_GIVEN = "|".join(sorted((MALE + " " + FEMALE).split(), key=len, reverse=True))
_TITLES = "|".join(x.replace(".", r"\.") for x in ADDRESS.split())
_L, _D = r"\p{L}", r"[0-9]"
PATTERNS = {
    "email": rf"(?<![{_L}0-9._%+-])[{_L}0-9._%+-]++@[{_L}0-9-]+(?:\.[{_L}0-9-]+)*\.{_L}{{2,}}",
    "ip": rf"(?<![0-9.])(?:25[0-5]|2[0-4]{_D}|1?{_D}?{_D})(?:\.(?:25[0-5]|2[0-4]{_D}|1?{_D}?{_D})){{3}}(?![0-9]|\.[0-9])",
    "phone": rf"(?<![{_L}0-9])\+{_D}{{1,3}}[ .-]?(?:\({_D}{{1,4}}\)[ .-]?)?{_D}{{2,4}}(?:[ .-]?{_D}{{2,4}}){{1,4}}(?!{_D})|(?<![{_L}0-9+])\({_D}{{3}}\) ?{_D}{{3}}[ .-]{_D}{{4}}(?!{_D})|(?<![{_L}0-9+.-]){_D}{{3}}[.-]{_D}{{3}}[.-]{_D}{{4}}(?![0-9-])",
    "number": rf"(?<![{_L}0-9.,-]){_D}{{4}}([ -]){_D}{{4}}\1{_D}{{4}}\1{_D}{{1,7}}(?![{_L}0-9])|(?<![{_L}0-9.,-]){_D}{{13,19}}(?![{_L}0-9])|(?<![{_L}0-9.,-]){_D}{{3}}-{_D}{{2}}-{_D}{{4}}(?![{_L}0-9-])|(?<![{_L}0-9])[A-Z]{{2}}{_D}{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_L}0-9])",
    "given": rf"(?<!{_L})(?=\p{{Lu}})(?:{_GIVEN})(?!{_L})",
    "surname": rf"(?<=[{_L}.] )\p{{Lu}}(?<=(?:^|[^\p{{L}}])(?:{_GIVEN}|{_TITLES}) \p{{Lu}})(?:['’]\p{{Lu}})?\p{{Ll}}+(?:\p{{Lu}}\p{{Ll}}+)*(?:[-'’]\p{{Lu}}\p{{L}}+)*",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Any capitalised word: a mention of a name if the text has that name elsewhere.
MENTION = rf"(?<!{_L})\p{{Lu}}(?:['’]\p{{Lu}})?{_L}+(?:[-'’]\p{{Lu}}{_L}+)*"
#: Stands around entities while their text is put together; texts that have it are searched twice instead.
EDGE = "\uffff"


def kind_of(value: Column) -> Column:
    """Entity type of a matched value; given names carry their gender."""
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & ~value.rlike(r"^[0-9]{3}\.[0-9]{3}\.[0-9]{4}$"), "ip")
        .when(value.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(value.rlike("[0-9]"), "number")
        .when(value.isin(*MALE.split()), "given_m")
        .when(value.isin(*FEMALE.split()), "given_f")
        .otherwise("surname")
    )


def _hash(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(2**31 - 1))


def _pick(base: Column, at, n: int) -> Column:
    return F.pmod(_hash(base, F.lit(at) if isinstance(at, int) else at), F.lit(n)).cast("int")


def _letter(first: str, base: Column, at: Column, n: int) -> Column:
    """A letter of a run of n code points from first on."""
    letters = F.lit("".join(chr(ord(first) + i) for i in range(n)))
    return F.substr(letters, _pick(base, at, n) + 1, F.lit(1))


def _alike(text: Column, base: Column) -> Column:
    """Each letter and digit redrawn within its script and case; the rest stays."""

    def redraw(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _letter("0", base, i, 10))
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), _letter("А", base, i, 32))
            .when(c.rlike(r"\p{IsCyrillic}"), _letter("а", base, i, 32))
            .when(c.rlike(r"\p{IsGreek}") & c.rlike(r"\p{Lu}"), _letter("Α", base, i, 17))
            .when(c.rlike(r"\p{IsGreek}"), _letter("α", base, i, 17))
            .when(c.rlike(r"\p{IsHan}"), _letter("一", base, i, 2000))
            .when(c.rlike(r"\p{Lu}"), _letter("A", base, i, 26))
            .when(c.rlike(r"\p{L}"), _letter("a", base, i, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, "", -1), redraw), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last is the check digit."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    v = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2))
    return F.aggregate(v, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10


_LATIN = [c + v for c in "bdfglmnprstv" for v in "aeiou"]
_CYRILLIC = [c + v for c in "бвдглмнрст" for v in "аеио"]


def _name(value: Column, base: Column, salt: Column, endings: dict[str, list[str]]) -> Column:
    def made(syllables: list[str], ends: list[str]) -> Column:
        parts = F.array(*map(F.lit, syllables))
        drawn = F.transform(F.sequence(F.lit(1), salt + 2), lambda k: F.get(parts, _pick(base, k, len(syllables))))
        return F.initcap(F.concat(F.array_join(drawn, ""), F.get(F.array(*map(F.lit, ends)), _pick(base, 0, len(ends)))))

    return F.when(value.rlike(r"\p{IsCyrillic}"), made(_CYRILLIC, endings["cyrillic"])).otherwise(made(_LATIN, endings["latin"]))


# Endings of made-up names by gender and script.
_ENDINGS = {
    "given_m": {"latin": ["n", "rd", "s", "rik", "ldo", "mund"], "cyrillic": ["н", "слав", "мир", "р"]},
    "given_f": {"latin": ["na", "lia", "tta", "nelle", "ssa", "ria"], "cyrillic": ["на", "лия", "ра", "ва"]},
    "surname": {"latin": ["man", "son", "ler", "ton", "ner", "court"], "cyrillic": ["нов", "ский", "ров", "ко"]},
}


def surrogate(kind: Column, value: Column, salt: Column, key: str) -> Column:
    """Keyed candidate of a value's own shape."""
    base = F.sha2(F.concat_ws("|", F.lit(key), kind, value, salt.cast("string")), 256)
    domain = F.regexp_extract(value, "@(.*)$", 1)
    top = F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    by_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.lower(domain), F.when(salt > 5, salt).otherwise(0).cast("string")), 256)
    email = F.concat(_alike(F.regexp_extract(value, "^(.*)@", 1), base), F.lit("@"), _alike(F.regexp_replace(domain, r"\.[^.]*$", ""), by_domain), top)
    code = F.regexp_extract(value, r"^(\+[0-9]{1,3})(?=[ .(-])", 1)
    phone = F.concat(code, _alike(F.substr(value, F.char_length(code) + 1), base))
    ip = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (F.lit(1) + _pick(base, i, 254)).cast("string")), ".")
    drawn = F.concat(F.left(value, F.lit(1)), _alike(F.substr(value, F.lit(2)), base))
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = F.regexp_replace(drawn, "[0-9]$", "")
    check = F.pmod(F.lit(10) - _luhn(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0"))), F.lit(10))
    card = F.when(value.rlike("^[0-9 -]{13,}$") & (F.when(value.rlike("^[0-9 -]+$"), _luhn(digits)) == 0), F.concat(body, check.cast("string"))).otherwise(drawn)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "number", card)
        .when(kind == "given_m", _name(value, base, salt, _ENDINGS["given_m"])).when(kind == "given_f", _name(value, base, salt, _ENDINGS["given_f"]))
        .otherwise(_name(value, base, salt, _ENDINGS["surname"]))
    )


def surrogates(values: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """(value, kind, surrogate) for distinct values; no two share a surrogate and none is a value itself."""
    if not key:
        raise ValueError("surrogates need a secret key")
    every = checkpointed(values.select("value").distinct())
    drawn = every.withColumns({"kind": kind_of(F.col("value")), "salt": F.lit(0)})
    kept = None
    for _ in range(max_rounds):
        drawn = checkpointed(drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("salt"), key)))
        # the first value with a candidate has it, unless it is a value or was given before
        first = drawn.groupBy("surrogate").agg(F.min("value").alias("value"))
        taken = every.select(F.col("value").alias("surrogate"))
        taken = taken if kept is None else taken.unionAll(kept.select("surrogate"))
        good = first.join(taken.join(drawn.select("surrogate").distinct(), "surrogate").distinct(), "surrogate", "left_anti").select("value", F.lit(True).alias("good"))
        judged = checkpointed(drawn.join(good, "value", "left"))
        fine = judged.where("good").select("value", "kind", "surrogate")
        kept = fine if kept is None else kept.unionAll(fine)
        drawn = judged.where("good is null").select("value", "kind", (F.col("salt") + 1).alias("salt"))
        if drawn.isEmpty():
            return kept
    raise ValueError(f"surrogates still clash after {max_rounds} draws")


def pieces(text: Column) -> Column:
    """A text cut around its entities and capitalised words: those are at places 1, 3, 5, ..."""
    one = f"{ENTITY}|{MENTION}"
    marked = F.split(F.regexp_replace(text, one, f"{EDGE}$0{EDGE}"), EDGE, -1)
    between, found = F.split(text, one, -1), F.regexp_extract_all(text, F.lit(one), F.lit(0))
    mixed = F.concat(F.array(F.get(between, F.lit(0))), F.flatten(F.zip_with(found, F.slice(between, 2, F.size(between)), lambda v, p: F.array(v, p))))
    return F.when(text.contains(EDGE), mixed).otherwise(marked)


def put(value: Column, known: Column) -> Column:
    """What a found piece becomes by the map of its text's values; null if it stays."""
    in_capitals = F.when(value == F.upper(value), F.upper(F.element_at(known, F.initcap(F.lower(value)))))
    return F.coalesce(F.element_at(known, value), in_capitals)


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten, and n_entities (long) appended."""
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(f"__{n}") for c, n in zip(text_key(F.col(text_col)), ("r1", "r2"))])
    found = rows.select("__r1", "__r2", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(ENTITY), F.lit(0)))).alias("value"))
    found = checkpointed(found.distinct())  # a row for each text and value
    named = surrogates(found, key)
    by_text = found.join(named.select("value", "surrogate"), "value").groupBy("__r1", "__r2").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("__map"))  # bounded by the text
    rows = rows.join(dealt_anew(by_text, "__r1", "__r2"), ["__r1", "__r2"], "left")
    changed = F.col("__map").isNotNull()
    # a column each, so that nothing is searched twice
    rows = rows.withColumn("__pieces", F.when(changed, pieces(F.col(text_col))))
    rows = rows.withColumn("__put", F.transform("__pieces", lambda x, i: F.when(i % 2 == 1, put(x, F.col("__map")))))
    again = F.array_join(F.zip_with("__pieces", "__put", lambda x, y: F.coalesce(y, x)), "")
    out = rows.withColumn("n_entities", F.when(changed, F.size(F.array_compact("__put"))).otherwise(0).cast("bigint"))
    return out.withColumn(text_col, F.when(changed, again).otherwise(F.col(text_col))).select(*[F.col(f"`{c}`") for c in columns], "n_entities")
