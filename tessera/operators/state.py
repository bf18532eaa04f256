"""Keyed run state: pending work, attempts, resets, records, decisions, release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.matching import bare_column

# Attempts, decisions that are released.
ATTEMPTS, VALIDATION_FAILURES = 4, 2
RELEASED = ("PASS", "ALLOW_LEXICAL", "ALLOW_LEXICAL_NAME")


def pending(plan: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Units not done with their present text, fresh ones before retries, each in plan order."""
    ok = done.select("id", F.col("text_sha256").alias("done_sha"))
    left = plan.join(ok, (plan.id == ok.id) & (plan.text_sha256 == ok.done_sha), "left_anti")
    retry = failed.select("id").distinct().withColumn("is_retry", F.lit(True))
    out = left.join(retry, "id", "left").withColumn("is_retry", F.coalesce("is_retry", F.lit(False)))
    return out.orderBy("is_retry", "idx")


def without_resolved(failed: DataFrame, completed: DataFrame) -> DataFrame:
    """Failures but those of completed units and of their clause children (an equi-join on the parent id)."""
    parent = F.regexp_replace("id", r":c\d+$", "")
    return failed.withColumn("__parent", parent).join(completed.select(F.col("id").alias("__parent")).distinct(), "__parent", "left_anti").drop("__parent")


def latest(records: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key, without sorting a key's records."""
    last = records.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*records.columns), F.struct(*order)).alias("__x"))
    return last.select("__x.*")


def outcome_of_attempts(takes: DataFrame, key: str, order: str, structural: Column, validated: Column) -> DataFrame:
    """First passing attempt of each unit among those that would be made: four at most, none after two validation failures."""
    w = Window.partitionBy(key).orderBy(order)
    rows = takes.withColumns({"attempt": F.row_number().over(w) - 1, "__s": structural, "__v": validated})
    failed_before = F.coalesce(F.sum(F.when(F.col("__s") & ~F.col("__v"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed_before = F.coalesce(F.max(F.when(F.col("__s") & F.col("__v"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"__f": failed_before, "__p": passed_before}).where((F.col("attempt") < ATTEMPTS) & (F.col("__f") < VALIDATION_FAILURES) & (F.col("__p") == 0))
    return rows.groupBy(key).agg(
        F.max(F.when(F.col("__s") & F.col("__v"), F.col("attempt"))).alias("passed_attempt"), F.count("*").alias("attempts"),
        F.count_if(~F.col("__s")).alias("structural_failures"), F.count_if(F.col("__s") & ~F.col("__v")).alias("validation_failures"),
    )


def decisions(units: DataFrame) -> DataFrame:
    """The adjudication ladder over plan-left-done-left-record rows, first matching rung.

    units has text, text_sha256, done_sha, omitted, wav, wav_sha, actual_wav_sha, record, record_sha, record_wav_sha,
    policy_ok, model_ok, take_passes, verdict, structural_ok, lenient, all_fragile, n_missing; and, maybe,
    only_logprob (no structural limit but that of the log probability is exceeded) and transcript: the words
    as expected, one for one, make up for a low log probability.
    """
    c = F.col
    same = lambda a, b: F.coalesce(c(a) == c(b), F.lit(False))
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    waived = F.lit(False)
    if {"only_logprob", "transcript"} <= set(units.columns):
        words = lambda t: F.transform(F.filter(F.split(c(t), r"\s+"), lambda w: w != ""), bare_column)
        waived = yes("only_logprob") & F.coalesce((F.size(words("text")) > 0) & (words("text") == words("transcript")), F.lit(False))
    ladder = [
        (yes("omitted"), "OMIT_UNSPEAKABLE"), (c("done_sha").isNull() | c("wav").isNull(), "BLOCK_MISSING"), (~same("done_sha", "text_sha256"), "BLOCK_STALE_TEXT"),
        (c("actual_wav_sha").isNull(), "BLOCK_MISSING"), (~same("wav_sha", "actual_wav_sha"), "BLOCK_STALE_WAV"), (~F.coalesce(c("text").rlike("[A-Za-z]"), F.lit(False)), "OMIT_UNSPEAKABLE"),
        (c("record").isNull(), "BLOCK_UNVALIDATED"), (~same("record_sha", "text_sha256") | ~same("record_wav_sha", "actual_wav_sha") | ~yes("policy_ok") | ~yes("model_ok"), "BLOCK_STALE_VALIDATION"),
        (yes("take_passes"), "PASS"), (c("verdict") == "PASS", "BLOCK_STRUCTURAL"), (~(yes("structural_ok") | waived), "BLOCK_STRUCTURAL"),
        (c("lenient") >= 0.85, "ALLOW_LEXICAL"), (yes("all_fragile") & (c("n_missing") > 0), "ALLOW_LEXICAL_NAME"),
    ]
    out = F.lit("BLOCK_LOW_COVERAGE")
    for condition, code in reversed(ladder):
        out = F.when(condition, code).otherwise(out)
    return units.withColumn("decision", out)


def with_children(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Replace blocked parents by their children where there are some: OMIT_PARENT_FALLBACK if all are included, else BLOCK_CHILD_INCOMPLETE."""
    included = F.col("decision").isin(*RELEASED) | F.col("decision").startswith("OMIT")
    per = children.groupBy("parent_id").agg(F.every(included).alias("complete"), F.count("*").alias("n_children"))
    out = parents.join(per, parents.id == per.parent_id, "left").drop("parent_id")
    blocked = F.col("decision").startswith("BLOCK") & F.col("n_children").isNotNull()
    return out.withColumn("decision", F.when(blocked & F.col("complete"), "OMIT_PARENT_FALLBACK").when(blocked, "BLOCK_CHILD_INCOMPLETE").otherwise(F.col("decision")))


def assembly_decision(units: DataFrame) -> DataFrame:
    """One row from (done, failed, record_ok) units: empty, failed, incomplete, blocked or release, in that order."""
    sums = units.agg(F.count("*").alias("units"), F.count_if("failed").alias("failed"), F.count_if(~F.col("done")).alias("incomplete"), F.count_if(F.col("done") & ~F.col("record_ok")).alias("blocked"))
    status = F.when(F.col("units") == 0, "empty").when(F.col("failed") > 0, "failed").when(F.col("incomplete") > 0, "incomplete").when(F.col("blocked") > 0, "blocked").otherwise("release")
    return sums.withColumn("status", status)


def context_depth(units: DataFrame, within: list[str], order: str, usable: Column, most: int = 3) -> DataFrame:
    """units with depth: how many units before it, of its own paragraph, a unit's context is built on.

    A chain breaks at a new paragraph, after a unit that isn't usable, and after one as deep as allowed (which
    passes nothing on); so within a run without the first two breaks, depth counts 0 to most again and again.
    """
    w = Window.partitionBy(*within).orderBy(order)
    broken = F.lag(~F.coalesce(usable, F.lit(False))).over(w)
    runs = units.withColumn("__run", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*within, "__run").orderBy(order)) - 1
    return runs.withColumn("depth", place % (most + 1)).drop("__run")


def units_done(plan: DataFrame, done: DataFrame, tail_peak_most: float = 0.02, validate: bool = True) -> DataFrame:
    """(id, is_done) of planned units; done has text_sha256, omitted, tail_peak, wav_sha256, actual_wav_sha256 and take_passes."""
    d = done.select("id", *[F.col(c).alias(f"__{c}") for c in ("text_sha256", "omitted", "tail_peak", "wav_sha256", "actual_wav_sha256", "take_passes")])
    audio = (F.coalesce("__tail_peak", F.lit(0.0)) <= tail_peak_most) & (F.col("__wav_sha256") == F.col("__actual_wav_sha256"))
    passed = audio & F.col("__take_passes") if validate else audio
    ok = (F.col("text_sha256") == F.col("__text_sha256")) & (F.coalesce("__omitted", F.lit(False)) | F.coalesce(passed, F.lit(False)))
    return plan.join(d, "id", "left").select("id", F.coalesce(ok, F.lit(False)).alias("is_done"))


def loaded(done: DataFrame, failed: DataFrame, relation: str, same_inputs: bool, force: bool = False, discard: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """(done, failed, archive): the recorded state that a run starts with, and whether the old one has to be kept aside first.

    State of the same inputs and plan (or of a part of it) is resumed.  Any other is an error unless the
    caller forces (it is carried over; units whose text changed don't count as done) or discards it.
    Failures of done units and of their children are dropped on every load.
    """
    if same_inputs and relation != "conflict":
        kept, archive = (done, failed), False
    elif discard:
        kept, archive = (done.limit(0), failed.limit(0)), True
    elif force:
        kept, archive = (done, failed), True
    else:
        raise ValueError("the recorded state belongs to other inputs or another plan: force or discard it, or start anew")
    return kept[0], without_resolved(kept[1], kept[0]), archive


def recorded(done: DataFrame, failed: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after outcomes (id, text_sha256, passed, reasons, at): a unit's last outcome moves it to done or failed, and out of the other.

    What passes also clears the failures of its children.
    """
    last = outcomes.groupBy("id").agg(F.max_by(F.struct("text_sha256", "passed", "reasons"), "at").alias("x")).select("id", "x.*")
    other = lambda table: table.join(last.select("id"), "id", "left_anti")
    now = other(done).select("id", "text_sha256").unionByName(last.where("passed").select("id", "text_sha256"))
    left = other(failed).select("id", "text_sha256", "reasons").unionByName(last.where("not passed").select("id", "text_sha256", "reasons"))
    return now, without_resolved(left, now)


def with_cache(units: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cached results of units, and computed ones for the misses only; compute maps a frame of misses to cache's columns."""
    hits = units.join(cache.select(key).distinct(), key, "left_semi").join(cache, key)
    misses = compute(units.join(cache, key, "left_anti"))
    return hits.select(*misses.columns, F.lit(True).alias("cached")).unionByName(misses.withColumn("cached", F.lit(False)))
