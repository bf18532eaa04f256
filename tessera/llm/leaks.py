"""Benchmark decontamination by canonical templates (operator 9).

One pattern cuts a text into raw tokens: numbers with a unit or currency (quantities), other numbers,
runs of capitalised words (names), and words.  Two templates are made of them, which don't depend on
case beyond that or on white space and punctuation:

* ``plain``: numbers and quantities become typed placeholders, everything else lower-cased words; so a
  copy in capitals, or wrapped anew, has the same windows;
* ``named``: names become placeholders as well, those that start a sentence too; so a question whose
  names were changed has the same windows.

The windows of ``WINDOW`` template tokens of benchmark items and documents meet in a hash join.  Slot
consistency then decides, for each text, item and template over all alignments together: each item value
stands for the text value that it meets in most windows, if that value meets no other item value in
more; windows with any other pair don't count (the same amount stays the same amount), but those without
slots or with consistent ones do.  A text holds an item if the windows that count are ``SHARE`` percent
of the item's windows or more, in either template; the one with the larger share is reported.

Everything is DataFrame functions.  The benchmark side of the join is broadcast only if it was counted
to have at most ``BROADCAST_WINDOWS`` windows; beyond that Spark chooses (a sort-merge join).  Window
hashes are 64-bit; a hit on a hash is checked on the window's tokens.

Rows: null and empty texts hold nothing; items shorter than the window are one window of their own
length, and those of under ``LEAST`` tokens must be the whole text; repeated rows (one id, one text) give
one result; very long texts are read whole; rows with null ids are compared like others; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, dealt_anew, text_key

WINDOW, LEAST, SHARE = 6, 4, 40
BROADCAST_WINDOWS = 300_000

# Units that make a number a quantity, in four languages.
UNITS = "kg|km|cm|mm|mg|ml|lbs?|oz|ft|mph|miles?|meters?|metres?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|pounds?|cents?|usd|eur|degrees?|grams?|liters?|litres?|percent"
UNITS += "|tagen?|stunden?|wochen?|monaten?|jahren?|minuten?|sekunden?|gramm|prozent|jours?|heures?|semaines?|mois|ans|grammes?|horas?|semanas?|meses|metros?|litros?|gramos?|kilos?"
GAP = r"[\x09-\x0D\p{Z}]"
# Repeated groups are possessive: nothing after them could match what they give back, and the pattern engine recurses into
# others once a repetition, so that a run of a thousand names or figures would overflow a task's stack and end its executor.
NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
# a figure is tried at its start only: from within it a search ends where it does from there
QUANTITY = rf"[$€£]{GAP}*{NUMBER}|(?=[0-9])(?<![0-9]|[0-9][.,:/]){NUMBER}(?:{GAP}*%|{GAP}*(?i:{UNITS})\b)"
NAME = r"(?<![\p{L}'’])\p{Lu}[\p{Ll}'’]++(?!\p{L})"
NAMES = rf"{NAME}(?:{GAP}++{NAME})*+"
RAW = rf"{QUANTITY}|{NUMBER}|{NAMES}|['’]*\p{{L}}[\p{{L}}'’]*"
NAME_MARK, QUANTITY_MARK, NUMBER_MARK = "\u0002", "\u0003", "\u0001"
PLAIN, NAMED = 0, 1


def _unmarked(text: Column) -> Column:
    """A text in which the marks are blanks; null is empty.  Few texts have any, and translate() goes character by character."""
    text, marks = F.coalesce(text, F.lit("")), NAME_MARK + QUANTITY_MARK + NUMBER_MARK
    any_mark = text.contains(marks[0]) | text.contains(marks[1]) | text.contains(marks[2])
    return F.when(any_mark, F.translate(text, marks, " " * len(marks))).otherwise(text)


def marked_figures(text: Column) -> Column:
    """A text with its quantities and numbers replaced by their marks."""
    text = _unmarked(text)
    return F.regexp_replace(F.regexp_replace(text, QUANTITY, f" {QUANTITY_MARK} "), NUMBER, f" {NUMBER_MARK} ")


def template_tokens(figures: Column, kind: int) -> Column:
    """The tokens of a template, without values: what template() gives, by a few passes over the whole text."""
    out = F.regexp_replace(figures, NAMES, f" {NAME_MARK} ") if kind == NAMED else figures
    return F.array_remove(F.split(F.lower(out), r"[^\p{L}\x01-\x03]+"), "")


def raw_tokens(text: Column) -> Column:
    text = _unmarked(text)
    return F.regexp_extract_all(text, F.lit(RAW), F.lit(0))


def template(raw: Column, kind: int) -> Column:
    """Tokens t of a template with the values v of its placeholders (empty for words)."""
    entry = lambda t, v: F.struct(t.alias("t"), v.alias("v"))

    def tokens(token: Column) -> Column:
        value = F.regexp_replace(F.lower(token), rf"{GAP}+", " ")
        quantity = token.rlike(r"[^0-9.,:/]")
        figure = F.array(entry(F.when(quantity, QUANTITY_MARK).otherwise(NUMBER_MARK), value))
        words = F.transform(F.array_remove(F.split(value, r"[^\p{L}]+"), ""), lambda w: entry(w, F.lit("")))
        named = F.array(entry(F.lit(NAME_MARK), F.regexp_replace(value, "['’]s?$", "")))
        other = F.when(token.rlike(f"^{NAMES}$"), named).otherwise(words) if kind == NAMED else words
        return F.when(token.rlike("^[0-9$€£]"), figure).otherwise(other)

    return F.flatten(F.transform(raw, tokens))


def _templates(df: DataFrame, keep: list[str]) -> DataFrame:
    df = df.select(*keep, raw_tokens(F.col("text")).alias("raw"))
    return df.select(*keep, template(F.col("raw"), PLAIN).alias("plain"), template(F.col("raw"), NAMED).alias("named"))


def _hashed(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _windows(hashes: str, many: int, **more: Column) -> Column:
    """(pos, h) of all windows of so many tokens, from a column of the tokens' hashes (a column, so that it is evaluated once)."""
    n = F.size(hashes)
    entry = lambda i: F.struct(*[c.alias(k) for k, c in more.items()], i.alias("pos"), F.xxhash64(*[F.get(hashes, i + k) for k in range(many)]).alias("h"))
    return F.when(n >= many, F.transform(F.sequence(F.lit(0), n - many), entry))


def _items(items: DataFrame) -> DataFrame:
    """(item_id, kind, width, tokens) of each template of each item."""
    both = _templates(items, ["item_id"])
    each = both.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("tokens")) for k, c in ((PLAIN, "plain"), (NAMED, "named"))])).alias("x"))
    return each.select("item_id", "x.kind", "x.tokens", F.least(F.lit(WINDOW), F.size("x.tokens")).alias("width")).where("width > 0").distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, r1, r2, item_id, matched_windows, item_windows, n_slots): texts that hold an item; r1, r2 are the text's key."""
    asked = _items(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")))
    widths = sorted(r.width for r in asked.select("width").distinct().collect())  # WINDOW numbers at most
    words = lambda tokens, at, width: F.array_join(F.transform(F.slice(tokens, at + 1, width), lambda x: x["t"]), " ")
    values = lambda tokens, at, width: F.transform(F.slice(tokens, at + 1, width), lambda x: x["v"])
    want = None
    hashed = asked.withColumn("t", F.transform("tokens", lambda x: x["t"])).withColumn("hashes", _hashed("t"))
    for width in widths or [WINDOW]:
        part = hashed.where(F.col("width") == width).select("item_id", "kind", "width", "tokens", F.inline(_windows("hashes", width)))
        part = part.select("item_id", "kind", "width", F.col("pos").alias("item_pos"), "h", words(F.col("tokens"), F.col("pos"), width).alias("words"), values(F.col("tokens"), F.col("pos"), width).alias("item_slots"))
        want = part if want is None else want.unionAll(part)
    per_item = want.groupBy("item_id", "kind", "width").agg(F.countDistinct("item_pos").alias("item_windows"))

    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)), F.col(text_col).alias("text"))
    keyed = ["doc_id", "r1", "r2"]
    tokened = rows.select(*keyed, marked_figures(F.col("text")).alias("f")).select(*keyed, template_tokens(F.col("f"), PLAIN).alias("plain"), template_tokens(F.col("f"), NAMED).alias("named"))
    hashes = tokened.select(*keyed, _hashed("plain").alias("plain"), _hashed("named").alias("named"))
    marked = lambda kind, col, width: _windows(col, width, kind=F.lit(kind), width=F.lit(width))
    # a window of an item under LEAST tokens must be the whole text
    each = [F.when(F.size(col) == width, marked(kind, col, width)) if width < LEAST else marked(kind, col, width) for kind, col in ((PLAIN, "plain"), (NAMED, "named")) for width in widths or [WINDOW]]
    windows = F.flatten(F.array_compact(F.array(*each)))
    key = want.select("h", "kind", "width", "item_id", "item_pos").distinct()
    found = hashes.select("doc_id", "r1", "r2", F.inline(windows)).join(F.broadcast(key) if want.count() <= BROADCAST_WINDOWS else key, ["h", "kind", "width"]).drop("h").distinct()
    found = checkpointed(found)  # hits only: rows of the texts are not among them

    # only texts with enough windows of an item are read again, for their slots
    enough = found.groupBy("doc_id", "r1", "r2", "item_id", "kind", "width").agg(F.countDistinct("item_pos").alias("n")).join(per_item, ["item_id", "kind", "width"])
    enough = enough.where(100 * F.col("n") >= SHARE * F.col("item_windows")).select("doc_id", "r1", "r2", "item_id", "kind", "width", "item_windows")
    keys = ["r1", "r2"]
    texts = rows.select(*keys, "text").join(dealt_anew(enough.select(*keys).distinct(), *keys), keys, "left_semi")
    # copies of a text go within their tasks first, and the join above stays free to split them
    texts = _templates(dealt_anew(texts, *keys).dropDuplicates(keys), keys)
    of = ["r1", "r2", "item_id", "kind"]
    held = found.drop("doc_id").distinct().join(enough.select(*of, "width", "item_windows").distinct(), [*of, "width"])
    held = held.join(texts, keys).join(want.drop("h"), ["item_id", "kind", "width", "item_pos"])
    tokens = F.when(F.col("kind") == PLAIN, F.col("plain")).otherwise(F.col("named"))
    held = held.withColumn("tokens", F.slice(tokens, F.col("pos") + 1, F.col("width"))).where(F.array_join(F.transform("tokens", lambda x: x["t"]), " ") == F.col("words"))
    pairs = F.array_distinct(F.filter(F.zip_with("item_slots", F.transform("tokens", lambda x: x["v"]), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] != ""))
    hit = checkpointed(held.select(*of, "item_windows", "item_pos", "pos", pairs.alias("pairs")))

    # each value stands for the one that it meets most
    met = hit.select(*of, F.explode("pairs").alias("p")).groupBy(*of, "p").agg(F.count("*").alias("n"))
    most = lambda c, other: F.row_number().over(Window.partitionBy(*of, f"p.{c}").orderBy(F.col("n").desc(), f"p.{other}"))
    good = met.withColumns({"x": most("a", "b"), "y": most("b", "a")}).where("x = 1 and y = 1").select(*of, "p", F.lit(True).alias("good"))
    judged = hit.select(*of, "item_windows", "item_pos", "pos", F.explode_outer("pairs").alias("p")).join(good, [*of, "p"], "left")
    judged = judged.groupBy(*of, "item_windows", "item_pos", "pos").agg(F.every(F.col("p").isNull() | F.coalesce("good", F.lit(False))).alias("ok"))
    counted = judged.where("ok").groupBy(*of, "item_windows").agg(F.countDistinct("item_pos").alias("matched_windows")).where(100 * F.col("matched_windows") >= SHARE * F.col("item_windows"))
    counted = counted.join(good.groupBy(*of).agg(F.count("*").alias("n_slots")), of, "left")
    best = F.max_by(F.struct("matched_windows", "item_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots")), F.struct(F.col("matched_windows") / F.col("item_windows"), -F.col("kind")))
    counted = counted.groupBy("r1", "r2", "item_id").agg(best.alias("x"))
    named = enough.select("doc_id", "r1", "r2", "item_id").distinct().join(counted, ["r1", "r2", "item_id"])
    return named.select("doc_id", "r1", "r2", "item_id", *[F.col(f"x.{c}").cast("bigint").alias(c) for c in ("matched_windows", "item_windows", "n_slots")])


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return leaks(docs, items).drop("r1", "r2").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item."""
    bad = dealt_anew(leaks(docs, items, id_col, text_col).select("r1", "r2").distinct(), "r1", "r2")
    keyed = docs.withColumns(dict(zip(("__r1", "__r2"), text_key(F.col(text_col)))))
    return keyed.join(bad, (F.col("__r1") == bad.r1) & (F.col("__r2") == bad.r2), "left_anti").drop("__r1", "__r2")


def leaks_sql(source: str = "documents") -> str:
    """Common table expressions up to ``leaked``(doc_id, item_id, matched_windows, item_windows, n_slots, rid).

    A parser of its own: a text is cut into words, figures and gaps character class by character class, names and
    quantities are put together from those pieces, and slots are judged over all pairs of a text and an item.
    """
    units = UNITS.replace("'", "")
    # pieces: figures; currency; percent; letters with apostrophes; gaps; anything else
    piece = "[0-9]+(?:[.,:/][0-9]+)*|[$€£%]|[''’]*\\p{L}[\\p{L}''’]*|[\\x09-\\x0D\\p{Z}\\x01-\\x03]+|[^0-9$€£%\\p{L}\\x09-\\x0D\\p{Z}\\x01-\\x03''’]+|[''’]+"
    figure, capital, gap = "regexp_full_match(p, '[0-9].*')", "regexp_full_match(p, '\\p{Lu}[\\p{Ll}''’]+')", "regexp_full_match(p, '[\\x09-\\x0D\\p{Z}]+')"
    return rf"""
l_texts AS (SELECT 'i' AS side, item_id AS id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM (SELECT DISTINCT item_id, text FROM benchmark)
  UNION ALL SELECT 'd', doc_id, row_number() OVER (), coalesce(text, '') FROM {source}),
l_piece AS (SELECT side, id, rid, unnest(range(len(ps))) AS spot, unnest(ps) AS p FROM (SELECT side, id, rid, regexp_extract_all(text, '{piece}') AS ps FROM l_texts)),
l_seen AS (SELECT *, {figure} AS fig, {capital} AS cap, {gap} AS gap, length(p) AS n, lead(p) OVER w AS p1, lead(p, 2) OVER w AS p2, lag(p) OVER w AS b1, lag(p, 2) OVER w AS b2 FROM l_piece WINDOW w AS (PARTITION BY side, rid ORDER BY spot)),
l_unit AS (SELECT *, CASE WHEN NOT fig THEN 0 WHEN p1 = '%' THEN 1 WHEN regexp_full_match(p1, '(?i:{units})') AND NOT regexp_matches(coalesce(p2, ''), '^[0-9]') THEN 1
    WHEN regexp_full_match(p1, '[\x09-\x0D\p{{Z}}]+') AND (p2 = '%' OR regexp_full_match(p2, '(?i:{units})')) THEN 2 ELSE 0 END AS after,
  CASE WHEN NOT fig THEN 0 WHEN b1 IN ('$', '€', '£') THEN 1 WHEN regexp_full_match(b1, '[\x09-\x0D\p{{Z}}]+') AND b2 IN ('$', '€', '£') THEN 2 ELSE 0 END AS before FROM l_seen),
l_used AS (SELECT *, coalesce(lag(CASE WHEN before > 0 THEN 0 ELSE after END) OVER w >= 1, false) OR coalesce(lag(CASE WHEN before > 0 THEN 0 ELSE after END, 2) OVER w = 2, false) AS taken FROM l_unit WINDOW w AS (PARTITION BY side, rid ORDER BY spot)),
l_open AS (SELECT *, cap AND NOT taken AS name, cap AND NOT taken AND regexp_full_match(b1, '[\x09-\x0D\p{{Z}}]+') AND lag(cap AND NOT taken, 2) OVER w AS joins FROM l_used WINDOW w AS (PARTITION BY side, rid ORDER BY spot)),
l_run AS (SELECT *, sum(CASE WHEN coalesce(joins, false) THEN 0 ELSE 1 END) OVER (PARTITION BY side, rid ORDER BY spot) AS run FROM l_open WHERE fig OR (NOT taken AND regexp_matches(p, '\p{{L}}'))),
l_word AS (SELECT side, id, rid, min(spot) AS spot, bool_or(fig) AS fig, bool_or(name) AS name, CASE WHEN NOT bool_or(fig) THEN lower(string_agg(p, ' ' ORDER BY spot))
    WHEN any_value(before) > 0 THEN any_value(CASE before WHEN 1 THEN b1 ELSE b2 || ' ' END) || any_value(p)
    WHEN any_value(after) > 0 THEN any_value(p) || any_value(CASE after WHEN 1 THEN lower(p1) ELSE ' ' || lower(p2) END) ELSE any_value(p) END AS v, any_value(before) + any_value(after) > 0 AS quantity FROM l_run GROUP BY side, id, rid, run),
l_token AS (SELECT side, id, rid, spot, 0 AS sub, 1 AS kind, CASE WHEN fig THEN CASE WHEN quantity THEN chr(3) ELSE chr(1) END ELSE chr(2) END AS t, CASE WHEN fig THEN v ELSE regexp_replace(v, '[''’]s?$', '') END AS v FROM l_word WHERE fig OR name
  UNION ALL SELECT side, id, rid, spot, 0, 0, CASE WHEN quantity THEN chr(3) ELSE chr(1) END, v FROM l_word WHERE fig
  UNION ALL SELECT side, id, rid, spot, unnest(range(len(ws))), k, unnest(ws), '' FROM (SELECT *, list_filter(regexp_split_to_array(v, '[^\p{{L}}]+'), lambda x: x <> '') AS ws FROM l_word WHERE NOT fig), (VALUES (0), (1)) AS ks(k) WHERE k = 0 OR NOT name),
l_row AS (SELECT *, row_number() OVER (PARTITION BY side, rid, kind ORDER BY spot, sub) - 1 AS pos, count(*) OVER (PARTITION BY side, rid, kind) AS size FROM l_token),
l_width AS (SELECT DISTINCT kind, least({WINDOW}, size) AS width FROM l_row WHERE side = 'i'),
l_six AS (SELECT *, list(t) OVER w AS ts, list(v) OVER w AS vals FROM l_row WINDOW w AS (PARTITION BY side, rid, kind ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
l_window AS (SELECT side, id, rid, l.kind, width, pos, array_to_string(ts[1:width], ' ') AS words, vals[1:width] AS vs
  FROM l_six l JOIN l_width x ON x.kind = l.kind AND pos + width <= size AND (side = 'd' OR width = least({WINDOW}, size)) AND (side = 'i' OR width >= {LEAST} OR width = size)),
l_want AS (SELECT DISTINCT id AS item_id, kind, width, pos AS item_pos, words, vs FROM l_window WHERE side = 'i'),
l_size AS (SELECT item_id, kind, count(DISTINCT item_pos) AS item_windows FROM l_want GROUP BY ALL),
l_hit AS (SELECT d.id AS doc_id, d.rid, w.item_id, w.kind, w.item_pos, d.pos, list_distinct(list_filter(list_zip(w.vs, d.vs), lambda p: p[1] <> '')) AS pairs
  FROM l_window d JOIN l_want w ON d.kind = w.kind AND d.width = w.width AND d.words = w.words WHERE d.side = 'd'),
l_met AS (SELECT rid, item_id, kind, p, count(*) AS n FROM (SELECT rid, item_id, kind, unnest(pairs) AS p FROM l_hit) GROUP BY ALL),
l_good AS (SELECT * FROM l_met QUALIFY row_number() OVER (PARTITION BY rid, item_id, kind, p[1] ORDER BY n DESC, p[2]) = 1 AND row_number() OVER (PARTITION BY rid, item_id, kind, p[2] ORDER BY n DESC, p[1]) = 1),
l_fits AS (SELECT rid, item_id, kind, list(p) AS fits FROM l_good GROUP BY ALL),
l_count AS (SELECT h.doc_id, h.rid, h.item_id, h.kind, count(DISTINCT item_pos) AS m, any_value(len(coalesce(fits, []))) AS n_slots
  FROM l_hit h LEFT JOIN l_fits f ON f.rid = h.rid AND f.item_id = h.item_id AND f.kind = h.kind WHERE len(list_filter(pairs, lambda p: NOT coalesce(list_contains(fits, p), false))) = 0 GROUP BY ALL),
leaked AS (SELECT doc_id, rid, item_id, m AS matched_windows, item_windows, n_slots FROM l_count JOIN l_size USING (item_id, kind) WHERE 100 * m >= {SHARE} * item_windows
  QUALIFY row_number() OVER (PARTITION BY rid, item_id ORDER BY m / item_windows DESC, kind) = 1)"""
