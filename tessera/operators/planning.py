"""Documents to lines, sentences, packed chunks with stable ids, and plan comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def lines(docs: DataFrame, id_col: str = "doc_id", numbers: bool = False) -> DataFrame:
    """(doc_id, para, text): the non-blank lines of documents after typography, with numbers as words if asked; para counts all lines."""
    raw = F.split(F.coalesce("text", F.lit("")), "\n")
    split = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(raw, T.typography)).alias("para", "text"))
    split = split.where("text <> ''")
    return split.withColumn("text", T.number_words("text")) if numbers else split


def chunk_id(chapter: Column, para: Column, s0: Column, s1: Column, start: Column, end: Column) -> Column:
    pad = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.lit(n), F.char_length(c.cast("string"))), F.lit("0"))
    return F.concat(chapter.cast("string"), F.lit(":p"), pad(para, 4), F.lit(":s"), pad(s0, 4), F.lit("-"), pad(s1, 4), F.lit(":o"), pad(start, 6), F.lit("-"), pad(end, 6))


def plan_chunks(docs: DataFrame, target: int = T.TARGET_WORDS, most: int = T.MOST_WORDS) -> DataFrame:
    """Chunks of whole sentences, packed greedily within a line.  One map over the documents, no shuffle.

    Sentences of a normalised line are one space apart, so offsets follow from their lengths.
    """
    rows = lines(docs).withColumn("s", T.sentences_sql(F.col("text")))
    rows = rows.withColumn("n", F.transform("s", lambda x: T.words(x)))
    rows = rows.withColumn("g", T.group_numbers(F.col("n"), target, most))
    group = F.explode(F.sequence(F.lit(0), F.array_max("g")))
    rows = rows.select("doc_id", "para", "s", "n", "g", group.alias("k"))  # a line has a sentence at least
    s0 = F.array_position("g", F.col("k")).cast("int") - 1
    rows = rows.withColumn("s0", s0).withColumn("m", F.size(F.filter("g", lambda x: x == F.col("k"))))
    before = F.slice("s", 1, F.col("s0"))
    start = F.aggregate(before, F.lit(0), lambda acc, x: acc + F.char_length(x) + 1)
    rows = rows.select("doc_id", "para", "s0", (F.col("s0") + F.col("m")).alias("s1"), start.alias("start"), F.array_join(F.slice("s", F.col("s0") + 1, F.col("m")), " ").alias("text"), F.aggregate(F.slice("n", F.col("s0") + 1, F.col("m")), F.lit(0), lambda a, x: a + x).alias("words"))
    rows = rows.withColumn("end", F.col("start") + F.char_length("text"))
    return rows.select(chunk_id(F.col("doc_id"), F.col("para"), F.col("s0"), F.col("s1"), F.col("start"), F.col("end")).alias("id"), "doc_id", "para", "s0", "s1", "start", "end", "words", F.sha2("text", 256).alias("text_sha256"), "text")


def plan_units(docs: DataFrame) -> DataFrame:
    """The full rule set: numbers as words, sentences with abbreviations, clauses, and greedy groups of clauses.  No shuffle."""
    rows = lines(docs, numbers=True).select("doc_id", "para", "text", F.explode(T.packed_units("text")).alias("x")).select("doc_id", "para", "text", "x.*")
    body = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select(chunk_id(F.col("doc_id"), F.col("para"), F.col("s0"), F.col("s1"), F.col("start"), F.col("end")).alias("id"), "doc_id", "para", "s0", "s1", "start", "end", "words", "clauses", F.sha2(body, 256).alias("text_sha256"))


def merged_lines(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Join a row to the one before it where that lacks a final mark and this starts in lower case."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(w)
    goes_on = ~before.rlike(r"[.!?][\"'’”)\]]*$") & F.col(text).rlike(r"^\p{Ll}")
    marked = rows.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = marked.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"), F.count("*").alias("pieces"))
    return joined.select(key, "part", F.array_join(F.col(f"x.{text}"), " ").alias(text), "pieces")


def plan_relation(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row: match, superset or conflict of two (id, hash, pos) plans, with the counts behind it."""
    both = stored.select("id", F.col("hash").alias("old"), F.col("pos").alias("old_pos")).join(new.select("id", F.col("hash").alias("new"), F.col("pos").alias("new_pos")), "id", "full_outer")
    sums = both.agg(
        F.count_if(F.col("old").isNotNull() & F.col("new").isNull()).alias("lost"), F.count_if(F.col("old") != F.col("new")).alias("changed"),
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("old_pos") != F.col("new_pos")).alias("moved"),
    )
    relation = F.when((F.col("lost") > 0) | (F.col("changed") > 0), "conflict").when((F.col("added") == 0) & (F.col("moved") == 0), "match").otherwise("superset")
    return sums.withColumn("relation", relation)


def parse_selection(spec: str, known: list[str]) -> list[str]:
    """Chapters of a request such as "1-3,preface", in the order of known; unknown names and reversed ranges are errors."""
    wanted: set[str] = set()
    for part in filter(None, (p.strip() for p in (spec or "").split(","))):
        a, dash, b = part.partition("-")
        if a.isdigit() and (not dash or b.isdigit()):
            if dash and int(a) > int(b):
                raise ValueError(f"reversed range {part}")
            wanted |= {f"ch{n:02d}" for n in range(int(a), int(b or a) + 1)}
        else:
            wanted.add(part)
    if missing := wanted - set(known):
        raise ValueError(f"unknown chapters {sorted(missing)}")
    return [k for k in known if k in wanted] if wanted else list(known)


def select_units(plan: DataFrame, chapters: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The plan of some chapters, and of its first units in order only if a limit is asked for."""
    if limit is not None and limit < 0:
        raise ValueError(f"limit must be >= 0, got {limit}")
    out = plan if chapters is None else plan.where(F.col("chapter").isin(*chapters))
    return out if limit is None else out.orderBy("idx").limit(limit)


def resume_units(plan: DataFrame, chapters: list[str], resume_from: str | None = None, limit: int | None = None) -> DataFrame:
    """The plan from one of its chapters on; the limit counts from there."""
    if resume_from is not None and resume_from not in chapters:
        raise ValueError(f"chapter {resume_from!r} is not in the plan ({', '.join(chapters)})")
    return select_units(plan, chapters if resume_from is None else chapters[chapters.index(resume_from) :], limit)


def eligible_clauses(spans: Column, text: Column) -> Column:
    """Spans (start, end, source_start, source_end, text, eligible) that are usable, in order; a missing text is cut from the unit's."""
    start, end = (lambda x: F.coalesce(x["start"], x["source_start"])), (lambda x: F.coalesce(x["end"], x["source_end"]))
    whole = F.transform(spans, lambda x: F.struct(start(x).alias("start"), end(x).alias("end"), F.coalesce(x["text"], F.substr(text, start(x) + 1, end(x) - start(x))).alias("text"), F.coalesce(x["eligible"], F.lit(True)).alias("eligible")))
    good = F.filter(whole, lambda x: x["eligible"] & x["start"].isNotNull() & (x["end"] > x["start"]) & (F.trim(x["text"]) != ""))
    return F.array_sort(F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))))
