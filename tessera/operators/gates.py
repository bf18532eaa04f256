"""Acceptance rules over takes and records, and the resets that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the gates, and the pauses that fail a take, in the order they are named.
NO_SPEECH, LOGPROB, COMPRESSION, GAP_S, MULTIPLICITY, COVERAGE = 0.6, -1.0, 2.4, 2.5, 3, 0.85
PAUSE_KINDS = ("sentence_end", "colon_semicolon", "parenthetical_comma")


def take_passes(verdict: Column, terminal: Column, boundaries: Column) -> Column:
    """Passed, ended as expected, and no aligned boundary failed; anything missing is no pass."""
    clean = F.forall(boundaries, lambda b: ~F.coalesce(b["aligned"] & ~b["passed"], F.lit(False)))
    return F.coalesce((verdict == "PASS") & terminal & clean, F.lit(False))


def record_ok(record: dict[str, Column], text_sha: Column, wav_sha: Column, policy: str, model: str) -> Column:
    """A record is current evidence: it passed, under this policy and model, on this text and audio."""
    return (record["verdict"].eqNullSafe(F.lit("PASS"))) & record["text_sha"].eqNullSafe(text_sha) & record["wav_sha"].eqNullSafe(wav_sha) & record["policy"].eqNullSafe(F.lit(policy)) & record["model"].eqNullSafe(F.lit(model))


def hard_gates(no_speech: Column, logprob: Column, compression: Column, full_scale: Column, gap_s: Column) -> Column:
    """Names of the structural limits exceeded; a missing measure exceeds none."""
    checks = {"no_speech": no_speech >= NO_SPEECH, "logprob": logprob < LOGPROB, "compression": compression > COMPRESSION, "full_scale": full_scale > 0, "gap": gap_s > GAP_S}
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))


def is_loop(multiplicity: Column, gram: Column, expected: Column, most: int = MULTIPLICITY) -> Column:
    """A repetition beyond the limit that the expected tokens (an array) don't repeat about as often."""
    words = F.split(gram, " ")
    n = F.size(words)
    starts = F.when(F.size(expected) >= n, F.sequence(F.lit(1), F.size(expected) - n + 1)).otherwise(F.array().cast("array<int>"))
    natural = F.size(F.filter(starts, lambda i: F.slice(expected, i, n) == words))
    return F.coalesce((multiplicity > most) & (natural < multiplicity - 1), F.lit(False))


def duration_ok(seconds: Column, low: Column, high: Column) -> Column:
    return F.coalesce(seconds.between(low, high), F.lit(False))


def failure_text(unit: Column, reasons: Column) -> Column:
    return F.concat(unit.cast("string"), F.lit(": every retry attempt failed: "), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("no diagnostic available"))


def children(spans: DataFrame, parent: str, order: str) -> DataFrame:
    """Child units of parents with several spans: id parent:cNNNN, idx parent * 10000 + n, n from one in span order."""
    from pyspark.sql import Window

    w = Window.partitionBy(parent)
    rows = spans.withColumns({"child_index": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w)}).where("__n > 1").drop("__n")
    digits = F.lpad(F.col("child_index").cast("string"), F.greatest(F.lit(4), F.char_length(F.col("child_index").cast("string"))), F.lit("0"))
    return rows.withColumns({"id": F.concat(F.col(parent).cast("string"), F.lit(":c"), digits), "idx": F.col(parent) * 10000 + F.col("child_index")})


def reset(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """table without the requested ids and their children."""
    wanted = ids.select(F.col("id").alias("__reset")).distinct()
    own = table.join(wanted, table[key] == wanted["__reset"], "left_anti").withColumn("__parent", F.regexp_replace(F.col(key), r":c\d+$", ""))
    return own.join(wanted, F.col("__parent") == F.col("__reset"), "left_anti").drop("__parent")


def unknown(ids: DataFrame, plan: DataFrame) -> DataFrame:
    """Requested ids that the plan doesn't have."""
    return ids.select("id").distinct().join(plan.select("id"), "id", "left_anti")


def promoted(failed: DataFrame, records: DataFrame) -> DataFrame:
    """Failures whose kept audio has a passing record on the present text."""
    good = records.where("verdict = 'PASS'").select("id", F.col("text_sha256").alias("__t"), F.col("wav_sha256").alias("__w"))
    return failed.join(good, "id").where((F.col("text_sha256") == F.col("__t")) & (F.col("wav_sha256") == F.col("__w"))).drop("__t", "__w")


def _quoted(values: Column) -> Column:
    """A list as it is shown in a reason: quoted, the first five."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(values, 1, 5), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def verdict(m: dict[str, Column]) -> Column:
    """struct(verdict, reasons) of a take's measures, by ten checks in order; what wasn't measured fails nothing.

    m has fraction, matched_tokens, expected_tokens, missing, mandatory_missing, terminal_expected, terminal_matched,
    no_speech, logprob, compression, most_repeated, multiplicity, gap_s, leakage_flagged, leakage_detail and boundaries
    (an array of structs with kind, gap_s, threshold_s and passed).
    """
    two, three = (lambda c: F.format_string("%.2f", c.cast("double"))), (lambda c: F.format_string("%.3f", c.cast("double")))
    checks = [
        (m["fraction"] < COVERAGE, F.concat(F.lit("coverage "), two(m["fraction"]), F.lit(f" < {COVERAGE} (matched "), m["matched_tokens"].cast("string"), F.lit("/"), m["expected_tokens"].cast("string"), F.lit(", missing "), _quoted(m["missing"]), F.lit(")"))),
        (F.size(m["mandatory_missing"]) > 0, F.concat(F.lit("mandatory missing: "), _quoted(m["mandatory_missing"]))),
        (~m["terminal_matched"], F.concat(F.lit("terminal phrase missing: '"), m["terminal_expected"], F.lit("'"))),
        (m["no_speech"] >= NO_SPEECH, F.concat(F.lit("no_speech_prob "), two(m["no_speech"]), F.lit(f" >= {NO_SPEECH}"))),
        (m["logprob"] < LOGPROB, F.concat(F.lit("avg_logprob "), two(m["logprob"]), F.lit(f" < {LOGPROB}"))),
        (m["compression"] > COMPRESSION, F.concat(F.lit("compression_ratio "), two(m["compression"]), F.lit(f" > {COMPRESSION}"))),
        (m["multiplicity"] >= MULTIPLICITY, F.concat(F.lit("repetition: n-gram '"), m["most_repeated"], F.lit("' x"), m["multiplicity"].cast("string"))),
        (m["gap_s"] > GAP_S, F.concat(F.lit("max internal gap "), two(m["gap_s"]), F.lit(f"s > {GAP_S}s"))),
        (m["leakage_flagged"], m["leakage_detail"]),
    ]
    named = F.array(*[F.when(F.coalesce(c, F.lit(False)), text) for c, text in checks])
    late = lambda kind: F.transform(F.filter(m["boundaries"], lambda b: (b["kind"] == kind) & (b["passed"] == F.lit(False))), lambda b: F.concat(F.lit(f"{kind} pause "), three(b["gap_s"]), F.lit("s < "), three(b["threshold_s"]), F.lit("s")))
    pauses = F.concat(*[F.coalesce(late(k), F.array().cast("array<string>")) for k in PAUSE_KINDS])
    reasons = F.concat(F.array_compact(named), pauses)
    return F.struct(F.when(F.size(reasons) > 0, "FAIL").otherwise("PASS").alias("verdict"), reasons.alias("reasons"))


def validation_failure(reasons: Column, terminal_expected: Column, terminal_matched: Column, boundaries: Column) -> Column:
    """Why a take failed validation: its reasons, or else what its record shows, or else a general text."""
    given = F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r != "")
    terminal = F.when(terminal_matched == F.lit(False), F.concat(F.lit("terminal phrase missing: '"), terminal_expected, F.lit("'")))
    late = F.transform(F.filter(F.coalesce(boundaries, F.array().cast("array<struct<kind:string,aligned:boolean,passed:boolean>>")), lambda b: b["aligned"] & (b["passed"] == F.lit(False))), lambda b: F.concat(F.coalesce(b["kind"], F.lit("punctuation")), F.lit(" pause failed")))
    shown = F.when(F.size(given) > 0, given).otherwise(F.concat(F.array_compact(F.array(terminal)), late))
    return F.when(F.size(shown) > 0, F.array_join(shown, "; ")).otherwise("terminal or punctuation gate failed")
