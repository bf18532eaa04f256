"""Statistics, paired deltas, gaps, verdict arrays, rollups and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, median, mean, min, max, p10, p90 and population standard deviation; interpolated percentiles."""
    v = F.col(value)
    sums = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(*map(F.lit, (0.5, 0.1, 0.9)))).alias("__q"),
    )
    return sums.select(*by, "n", F.get("__q", F.lit(0)).alias("median"), "mean", "low", "high", F.get("__q", F.lit(1)).alias("p10"), F.get("__q", F.lit(2)).alias("p90"), "std")


def delta_percent(base: Column, other: Column) -> Column:
    """Improvement over base in percent; null when base is zero."""
    return (base - other) / F.nullif(base, F.lit(0.0)) * 100


def paired(df: DataFrame, repeat: str, candidate: str, value: str, baseline: str) -> DataFrame:
    """(repeat, candidate, base, value, delta) for the repeats that both the baseline and the candidate have."""
    one = df.groupBy(repeat, candidate).agg(F.sum(value).alias("value"))
    base = one.where(F.col(candidate) == baseline).select(repeat, F.col("value").alias("base"))
    return one.where(F.col(candidate) != baseline).join(base, repeat).withColumn("delta", delta_percent(F.col("base"), F.col("value")))


def mean_places(scaled: Column, more: int) -> Column:
    """The mean of integers (values times 100, say) rounded half up to so many more places, as an aggregate; the order of rows changes nothing."""
    n, up = F.count("*"), 10**more
    return F.floor((F.sum(scaled) * (2 * up) + n) / (2 * n)) / (100 * up)


def workload_seconds(generation: Column, precompute: Column) -> dict[str, Column]:
    """Cold seconds count the live precompute once, amortized ones don't."""
    return {"cold": generation + F.coalesce(precompute, F.lit(0.0)), "amortized": generation}


def workload_stats(workers: DataFrame, repeat: str, candidate: str, generation: str, precompute: str) -> DataFrame:
    """stats() of the seconds of each candidate in both modes, with all repeats."""
    modes = workload_seconds(F.col(generation), F.col(precompute))
    each = workers.select(repeat, candidate, F.explode(F.create_map(*[x for k, v in modes.items() for x in (F.lit(k), v)])).alias("mode", "seconds"))
    return stats(each, [candidate, "mode"], "seconds")


def pairs_by_repeat(pairs: DataFrame, repeat: str, candidate: str, candidates: list[str]) -> DataFrame:
    """paired() as a row a repeat with a delta column a candidate."""
    return pairs.groupBy(repeat).pivot(candidate, candidates).agg(F.first("delta"))


def estimate(words: Column, pilot: dict[str, float | None]) -> dict[str, Column]:
    """Projected audio, generation, transcription and total seconds of so many words, by the measures of a pilot; one place."""
    for name in ("audio_s_per_word", "tokens_per_audio_s", "generation_s_per_token"):
        if pilot.get(name) is None:
            raise ValueError(f"the pilot has no {name}")
    audio = words * pilot["audio_s_per_word"]
    generation = audio * pilot["tokens_per_audio_s"] * pilot["generation_s_per_token"]
    asr = audio * pilot["asr_rtf"] if pilot.get("asr_rtf") else F.lit(None).cast("double")
    total = F.lit(pilot.get("load_s") or 0.0) + generation + F.coalesce(asr, F.lit(0.0))
    return {k: F.round(v, 1) for k, v in {"audio_s": audio, "generation_s": generation, "asr_s": asr, "total_s": total}.items()}


def remaining_seconds(audio_s: Column, rtf: Column) -> Column:
    """Projected transcription of audio that is left; null without a measured rate."""
    return F.round(audio_s * F.when(rtf != 0, rtf), 1)


def bench_verdict(pairs: DataFrame, candidate: str, material: float = 10.0) -> DataFrame:
    """One row: the best candidate's median delta decides improvement, regression or neither."""
    medians = pairs.groupBy(candidate).agg(F.percentile("delta", 0.5).alias("median_delta"), F.count("*").alias("repeats"))
    best = F.max("median_delta").over(Window.partitionBy(F.lit(1)))  # one row a candidate
    verdict = F.when(best >= material, "improvement").when(best <= -material, "regression").otherwise("not_material")
    return medians.withColumn("verdict", verdict)


def rotated_order(candidate_pos: Column, repeat: Column, n: int) -> Column:
    return F.pmod(candidate_pos - (repeat - 1), F.lit(n))


def gap_metrics(events: DataFrame, key: str, start: Column, end: Column, order: list[str], long_gap_s: float = 1.0) -> DataFrame:
    """Per key: words, first start, last end, largest gap and number of long gaps, in microseconds."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.select(key, *[o for o in order if o != key], start.alias("__a"), end.alias("__b"))
    rows = rows.withColumn("gap_us", F.timestamp_diff("MICROSECOND", F.lag("__b").over(w), F.col("__a")))
    return rows.groupBy(key).agg(F.count("*").alias("words"), F.min("__a").alias("first_start"), F.max("__b").alias("last_end"), F.max("gap_us").alias("max_gap_us"), F.count_if(F.col("gap_us") > int(long_gap_s * 1e6)).alias("long_gaps"))


def assembly_offsets(units: DataFrame, chapter: str, order: str, para: str, frames: str, leading: str, trailing: str, rate: int = 24000) -> DataFrame:
    """Start and end sample of each unit; silence fills boundaries up to 250 ms, 500 ms between paragraphs."""
    w = Window.partitionBy(chapter).orderBy(order)
    least = F.when(F.lead(para).over(w) != F.col(para), rate // 2).otherwise(rate // 4)
    silence = F.when(F.lead(order).over(w).isNull(), 0).otherwise(F.greatest(F.lit(0), least - F.col(trailing) - F.lead(leading).over(w)))
    rows = units.withColumn("silence_after", silence.cast("bigint"))
    start = F.coalesce(F.sum(F.col(frames) + F.col("silence_after")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start_sample", start.cast("bigint")).withColumn("end_sample", (F.col("start_sample") + F.col(frames)).cast("bigint"))


def reasons(**checks: Column) -> Column:
    """Names of the checks that are true, in order; null counts as not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))


def ngrams(tokens: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """(size, position, gram) of all runs of a token array."""
    one = lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.struct(F.lit(n).alias("size"), i.alias("at"), F.array_join(F.slice(tokens, i, n), " ").alias("gram")))).otherwise(F.array().cast("array<struct<size:int,at:int,gram:string>>"))
    return F.concat(*[one(n) for n in sizes])
