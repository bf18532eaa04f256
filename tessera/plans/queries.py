"""Registered queries over the driver's tables, one for each operator or family of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import hashing, matching, signal, speech, text, tokens
from tessera.operators import aggregates as agg
from tessera.operators import gates, planning, state
from tessera.session import table
from tessera.sources import files, markup

REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def docs(spark, sf):
    return table(spark, sf, "documents")


def plain_tokens(c: Column) -> Column:
    """Lower-case letters and digits: the tokens of queries that SQL checks."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


# --- planning ---------------------------------------------------------------


@query
def plan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return planning.plan_chunks(docs(spark, sf)).drop("text")


@query
def plan_units(spark, sf):
    return planning.plan_units(docs(spark, sf))


@query
def typography_normalize(spark, sf):
    return planning.lines(docs(spark, sf)).select("doc_id", "para", F.char_length("text").alias("chars"), F.sha2("text", 256).alias("sha"))


@query
def word_counts_by_lang(spark, sf):
    rows = docs(spark, sf).select("lang", "source", text.words(F.col("text")).alias("w"), text.spaced_words(F.col("text")).alias("s"))
    return rows.rollup("lang", "source").agg(F.count("*").alias("documents"), F.sum("w").cast("bigint").alias("words"), F.sum("s").cast("bigint").alias("spaced_words"))


@query
def sentence_split(spark, sf):
    rows = planning.lines(docs(spark, sf)).select("doc_id", "para", F.posexplode(text.sentences_sql(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", "para", "pos", F.char_length("sentence").alias("chars"), text.words(F.col("sentence")).cast("bigint").alias("words"))


@query
def sentence_spans(spark, sf):
    rows = planning.lines(docs(spark, sf)).select("doc_id", "para", F.explode(text.sentence_spans("text")).alias("s"))
    return rows.select("doc_id", "para", "s.start", "s.end", "s.words")


@query
def unspeakable_units(spark, sf):
    """Lines and single words that have nothing to say, by document."""
    lines = docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("unit"), F.lit("line").alias("kind"))
    words = docs(spark, sf).select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("unit"), F.lit("word").alias("kind"))
    return lines.unionAll(words).where(text.unspeakable(F.col("unit"))).groupBy("doc_id", "kind").agg(F.count("*").alias("unspeakable"))


@query
def merged_lines(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "line")).where("trim(line) <> ''")
    out = planning.merged_lines(rows, "doc_id", "para", "line")
    return out.select("doc_id", "part", "pieces", F.char_length("line").alias("chars"))


@query
def plan_relation(spark, sf):
    """The plan of all documents against one made before the newest tenth existed."""
    plan = docs(spark, sf).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("pos"))
    newest = plan.agg(F.max("id")).first()[0] or 0  # one number
    old = plan.where(F.col("id") * 10 <= newest * 9)
    return planning.plan_relation(old, plan).select("lost", "changed", "added", "moved", "relation")


@query
def selected_chapters(spark, sf):
    """Rows of requested names in the table's own order."""
    names = [r.n_name for r in table(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 rows
    wanted = planning.parse_selection(",".join(reversed(names[5:15])), names)
    ask = spark.createDataFrame([(w,) for w in wanted], "n_name string")
    return table(spark, sf, "nation").join(ask, "n_name", "left_semi").select("n_nationkey", "n_name")


# --- text functions -----------------------------------------------------------


@query
def number_words(spark, sf):
    rows = docs(spark, sf).where(F.col("text").rlike("[0-9]")).select("doc_id", text.number_words("text").alias("t"))
    return rows.select("doc_id", F.char_length("t").alias("chars"), text.words(F.col("t")).alias("words"))


@query
def speak_text(spark, sf):
    return docs(spark, sf).select("doc_id", speech.speak_text("text").alias("t")).select("doc_id", F.sha2("t", 256).alias("spoken_sha256"))


@query
def tokenize_variants(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", tokens.readings_of("text").alias("r"))
    return rows.select("conv_id", "turn", F.posexplode("r").alias("reading", "t")).select("conv_id", "turn", "reading", F.size("t").alias("tokens"))


@query
def phonetic_skeletons(spark, sf):
    words = table(spark, sf, "part").select(F.explode(plain_tokens(F.col("p_name"))).alias("word")).unionAll(table(spark, sf, "conversations").select(F.explode(plain_tokens(F.col("text"))).alias("word"))).distinct()
    return words.select("word", matching.skeleton_column(F.col("word")).alias("skeleton"))


def _word_pairs(spark, sf) -> DataFrame:
    """Neighbouring words of the sorted vocabulary of conversations."""
    words = table(spark, sf, "conversations").select(F.explode(plain_tokens(F.col("text"))).alias("a")).distinct()
    w = Window.partitionBy(F.left("a", F.lit(1))).orderBy("a")
    return words.withColumn("b", F.lead("a").over(w)).where("b is not null")


@query
def levenshtein_candidates(spark, sf):
    return _word_pairs(spark, sf).withColumn("distance", F.levenshtein("a", "b")).where("distance <= 2")


@query
def vowel_swap_pairs(spark, sf):
    return _word_pairs(spark, sf).where(matching.vowel_swap_column(F.col("a"), F.col("b")))


@query
def phonetic_matches(spark, sf):
    return _word_pairs(spark, sf).where(matching.sounds_like_column(F.col("a"), F.col("b")))


@query
def attempt_seed(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", hashing.attempt_seed(F.lit(1234567), F.col("o_orderkey"), F.lit(2)).alias("seed"))


@query
def content_identity(spark, sf):
    return docs(spark, sf).select("doc_id", hashing.text_hash(F.col("text")).alias("text_sha256"), hashing.cache_key(F.lit("policy-1"), F.col("lang"), F.sha2("text", 256)).alias("cache_key"))


@query
def html_paragraphs(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", markup.parsed("html").alias("p"))
    return rows.select("page_id", F.col("p.heading").alias("heading"), F.posexplode("p.paragraphs").alias("para", "text"))


@query
def metadata_blocks(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_regionkey"), F.concat(F.col("n_name"), F.lit(" = 1; #")).alias("v"))
    return rows.select("n_regionkey", files.metadata_escape(F.col("v")).alias("escaped"))


# --- alignment ------------------------------------------------------------------


def _turn_texts(spark, sf) -> DataFrame:
    """Each turn with the one before it as its expected text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).where("before is not null")


def _tokens(rows: DataFrame) -> DataFrame:
    """All tokens of both texts."""
    return rows.withColumns({"heard": plain_tokens(F.col("text")), "expected": plain_tokens(F.col("before"))})


def _turns(spark, sf) -> DataFrame:
    return _tokens(_turn_texts(spark, sf))


@query
def turn_coverage(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", matching.coverage_of("expected", "heard").alias("c")).select("conv_id", "turn", "c.expected_tokens", "c.matched_tokens", "c.fraction")


@query
def fuzzy_alignment(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.explode(matching.alignment_of("expected", "heard")).alias("expected_at", "heard_at"))


@query
def mandatory_terms(spark, sf):
    """Distinct content words of six letters or more, or numbers (hyphen-free tokens)."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(plain_tokens(F.col("text"))).alias("t"))
    stop = F.array(*[F.lit(w) for w in sorted(matching.FUNCTION_WORDS)])
    keep = lambda w: w.rlike("^[0-9]+$") | w.rlike("^[0-9]+0s$") | (w.rlike("^[a-z]{6,}$") & ~F.array_contains(stop, w))
    return rows.select("conv_id", "turn", F.size(F.filter("t", keep)).alias("terms"), F.array_join(F.filter("t", keep), " ").alias("all_terms"))


@query
def mandatory_check(spark, sf):
    rows = _turns(spark, sf).withColumn("terms", matching.terms_of(F.array_join("expected", " "))).select("conv_id", "turn", matching.mandatory_of("heard", "terms").alias("m"))
    return rows.select("conv_id", "turn", F.size("m.missing").alias("missing"), F.size("m.missing_fragile").alias("missing_fragile"), F.size("m.hyphen_matches").alias("joined"))


@query
def terminal_suffix(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", matching.terminal_of("expected", "heard").alias("t")).select("conv_id", "turn", "t.expected", "t.matched")


@query
def lenient_coverage(spark, sf):
    rows = _turns(spark, sf).withColumn("names", F.array_distinct(F.transform(F.regexp_extract_all("before", F.lit(r"\b[A-Z][a-z]+"), F.lit(0)), matching.bare_column)))
    rows = rows.select("conv_id", "turn", matching.lenient_of(F.array_join("expected", " "), F.array_join("heard", " "), "names").alias("l"))
    return rows.select("conv_id", "turn", "l.fraction", F.size("l.missing").alias("missing"), "l.all_fragile")


@query
def punctuation_pauses(spark, sf):
    """Boundaries of each turn's sentences against timings made from word positions, summed by kind."""
    spoken = F.transform(tokens.tokens_of("text"), lambda t, i: F.struct(t.alias("text"), (i * 0.3).alias("start"), (i * 0.3 + 0.1 + (i % 3) * 0.1).alias("end")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.sentences_sql(F.col("text"))).alias("text"))
    rows = rows.select("conv_id", "turn", "text", spoken.alias("w")).select("conv_id", "turn", F.explode(matching.pauses_of("text", "w")).alias("p"))
    return rows.groupBy("p.kind").agg(F.count("*").alias("checked"), F.count_if("p.aligned").alias("aligned"), F.count_if(F.col("p.passed") == F.lit(True)).alias("passed"), F.count_if(F.col("p.passed") == F.lit(False)).alias("failed"), F.count_if(~F.col("p.aligned")).alias("unaligned"))


def _dealt_turns(spark, sf) -> DataFrame:
    """Turns by themselves, so that a long conversation's n-grams are counted in many tasks."""
    return _tokens(_turn_texts(spark, sf).repartition("conv_id", "turn"))


@query
def ngram_repetition(spark, sf):
    """N-grams repeated beyond the turn before; the most frequent, then shortest, then first.

    Both turns' n-grams are counted at once where the turn lies.  A join would take the expected ones for as small as
    their texts and send all of them to the driver as a broadcast.
    """
    side = lambda c: F.transform(agg.ngrams(F.col(c)), lambda g: F.struct(g["size"].alias("size"), g["gram"].alias("gram"), F.when(F.lit(c == "heard"), g["at"]).alias("at")))
    grams = _dealt_turns(spark, sf).select("conv_id", "turn", F.explode(F.concat(side("heard"), side("expected"))).alias("g"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()  # a turn without ids has no expected text
    counts = grams.groupBy("conv_id", "turn", F.col("g.size").alias("size"), F.col("g.gram").alias("gram")).agg(F.count("g.at").alias("n"), F.count_if(F.col("g.at").isNull() & known).alias("e"), F.min("g.at").alias("at"))
    best = F.max_by(F.struct("gram", "n"), F.struct("n", -F.col("size"), -F.col("at")))
    return counts.where("n > 1 and n > e").groupBy("conv_id", "turn").agg(best.alias("b"), F.count("*").alias("repeated")).select("conv_id", "turn", F.col("b.gram").alias("most_repeated"), F.col("b.n").alias("max_multiplicity"), "repeated")


@query
def leakage_overlap(spark, sf):
    """Benchmark items of which a document has four fifths of the distinct words or more.

    Such a document has one of any fifth of them and one word more: only an item's rarest words (among
    items) are joined on, and the pairs they find are compared as a whole.
    """
    texts = docs(spark, sf).select("doc_id", F.array_distinct(plain_tokens(F.col("text"))).alias("words"))
    items = table(spark, sf, "benchmark").select("item_id", F.array_distinct(plain_tokens(F.col("text"))).alias("t"))
    of = items.select("item_id", F.size("t").alias("size"), F.explode("t").alias("w"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "w"))
    rare = of.join(of.groupBy("w").agg(F.count("*").alias("n")), "w").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * 8 / 10) + 1).select("item_id", "w")
    small = items.count() <= 10_000
    seen = texts.select("doc_id", F.explode("words").alias("w")).join(F.broadcast(rare) if small else rare, "w").select("doc_id", "item_id").distinct()
    both = seen.join(F.broadcast(items) if small else items, "item_id").join(texts, "doc_id")
    hits = both.select("doc_id", "item_id", F.size(F.array_intersect("words", "t")).cast("bigint").alias("shared"), F.size("t").alias("size"))
    return hits.where("shared * 10 >= size * 8")


# --- signals ----------------------------------------------------------------------


@query
def signal_facts(spark, sf):
    x = F.col("embedding")
    rows = table(spark, sf, "embeddings").select("vec_id", F.size(x).alias("samples"), F.round(signal.rms(x), 4).alias("rms"), F.round(signal.peak(x), 4).alias("peak"), F.round(signal.active_ratio(x), 4).alias("active"), F.size(F.filter(x, lambda v: F.abs(v) >= 1.0)).alias("full_scale"))
    facts = {"sample_rate": F.lit(24000), "channels": F.lit(1), "subtype": F.lit("PCM_16"), "samples": F.col("samples"), "fresh": F.lit(True), "finite": F.lit(True), "rms": F.col("rms"), "active_ratio": F.col("active"), "peak": F.col("peak"), "full_scale": F.col("full_scale")}
    return rows.withColumn("failed_gates", F.array_join(signal.gates(facts), ","))


@query
def tail_and_quiet(spark, sf):
    x = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(signal.tail_peak(x, 8), 4).alias("tail_peak"), signal.trailing_quiet(x, 0.05).alias("trailing"), signal.leading_quiet(x, 0.05).alias("leading"))


@query
def spectral_shares(spark, sf):
    x = F.flatten(F.array_repeat("embedding", 20))
    return table(spark, sf, "embeddings").select("vec_id", signal.speech_share_of(x).alias("speech_share"), signal.sibilant_share_of(x, F.lit("voices")).alias("sibilant_share"))


@query
def padded_codes(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size(hashing.padded_to(F.col("embedding"), 25)).alias("padded"))


# --- timings and assembly -------------------------------------------------------------


@query
def gap_metrics(spark, sf):
    e = table(spark, sf, "events")
    return agg.gap_metrics(e.withColumn("__e", F.col("ts")), "user_id", F.col("ts"), F.col("ts"), ["ts", "event_id"], 3600.0)


@query
def assembly_offsets(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("para"), (F.char_length("text") * 1000).cast("bigint").alias("frames"), (F.char_length("text") % 7 * 500).cast("bigint").alias("lead"), (F.char_length("text") % 5 * 700).cast("bigint").alias("trail"))
    return agg.assembly_offsets(c, "conv_id", "turn", "para", "frames", "lead", "trail").select("conv_id", "turn", "silence_after", "start_sample", "end_sample")


@query
def chapter_rollup(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = o.groupBy("n_nationkey", "n_name").agg(F.count("*").alias("units"), F.sum(F.floor(F.col("o_totalprice"))).cast("bigint").alias("frames"))
    w = Window.partitionBy(F.lit(0)).orderBy("n_nationkey")  # one row a nation
    before = F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("start_ms", F.bround(before * 1000 / 24000).cast("bigint")).withColumn("end_ms", F.bround((before + F.col("frames")) * 1000 / 24000).cast("bigint")).drop("frames")


@query
def running_totals(spark, sf):
    """Generated and validated seconds with their ratio by line status; null-safe."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("audio_s"), F.round(F.sum("l_discount") / F.nullif(F.sum("l_quantity"), F.lit(0.0)), 6).alias("rtf"))


@query
def eta_projection(spark, sf):
    """What all documents would take by a pilot's measures, and the transcription of half of it at its rate."""
    d = docs(spark, sf).agg(F.sum(text.spaced_words(F.col("text"))).cast("bigint").alias("words"))
    out = agg.estimate(F.col("words"), {"audio_s_per_word": 0.5, "tokens_per_audio_s": 12.0, "generation_s_per_token": 0.125, "asr_rtf": 0.25, "load_s": 40.0})
    return d.select("words", *[c.alias(k) for k, c in out.items()]).withColumn("remaining_s", agg.remaining_seconds(F.col("audio_s") / 2, F.lit(0.25)))


# --- benchmark statistics ---------------------------------------------------------------


@query
def bench_stats(spark, sf):
    out = agg.stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 3).alias(c) for c in ("median", "mean", "low", "high", "p10", "p90", "std")])


def _pairs(spark, sf):
    o = table(spark, sf, "orders").select(F.month("o_orderdate").alias("repeat"), F.col("o_orderpriority").alias("candidate"), F.floor("o_totalprice").alias("v"))
    return agg.paired(o, "repeat", "candidate", "v", "1-URGENT")


@query
def bench_paired_delta(spark, sf):
    return _pairs(spark, sf).select("repeat", "candidate", F.col("base").cast("bigint").alias("base"), F.col("value").cast("bigint").alias("value"), F.round("delta", 3).alias("delta"))


@query
def bench_verdict(spark, sf):
    return agg.bench_verdict(_pairs(spark, sf), "candidate").select("candidate", F.round("median_delta", 3).alias("median_delta"), "repeats", "verdict")


@query
def paired_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority").distinct().withColumn("pos", (F.left("o_orderpriority", F.lit(1)).cast("int") - 1))
    return o.select("o_orderpriority", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("repeat"), "pos").select("o_orderpriority", "repeat", agg.rotated_order(F.col("pos"), F.col("repeat"), 5).alias("place"))


# --- state ------------------------------------------------------------------------------


def _plan(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("text_sha256"), F.col("doc_id").alias("idx"), "text", "lang")


def _done(spark, sf):
    """Units with a label count as done; a toxic one with another text's hash."""
    l = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "text"), "doc_id")
    return l.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("text_sha256"), "quality", "toxic")


@query
def pending_units(spark, sf):
    done = _done(spark, sf)
    return state.pending(_plan(spark, sf), done, done.where("quality = 0")).select("id", "idx", "is_retry")


@query
def records_upsert(spark, sf):
    e = table(spark, sf, "events")
    return state.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def resolved_failures(spark, sf):
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(":c"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0")).alias("id"))
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"))
    return state.without_resolved(failed, done).groupBy("id").agg(F.count("*").alias("n"))


def _decided(spark, sf):
    d = _done(spark, sf).select("id", F.col("text_sha256").alias("done_sha"), "quality", "toxic")
    u = _plan(spark, sf).join(d, "id", "left")
    n = F.col("idx")
    made = F.col("done_sha").isNotNull()
    return state.decisions(u.select(
        "id", "idx", "text", "text_sha256", "done_sha", F.lit(False).alias("omitted"), F.when(made, F.lit("w")).alias("wav"), F.when(made, "a").alias("wav_sha"), F.when(made, F.when(n % 17 == 0, "b").otherwise("a")).alias("actual_wav_sha"),
        F.when(n % 5 != 0, n).alias("record"), F.col("text_sha256").alias("record_sha"), F.lit("a").alias("record_wav_sha"), (n % 19 != 0).alias("policy_ok"), F.lit(True).alias("model_ok"),
        (F.col("quality") == 1).alias("take_passes"), F.when(n % 7 == 0, "PASS").otherwise("FAIL").alias("verdict"), (n % 3 != 0).alias("structural_ok"), F.when(n % 2 == 0, 0.9).otherwise(0.5).alias("lenient"), (n % 11 < 5).alias("all_fragile"), (n % 4).alias("n_missing"),
    ))


@query
def adjudicate_decisions(spark, sf):
    return _decided(spark, sf).groupBy("decision").agg(F.count("*").alias("units"), F.sum("idx").alias("ids"))


@query
def parent_fallback(spark, sf):
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "PASS").otherwise("BLOCK_STRUCTURAL").alias("decision"))
    children = table(spark, sf, "lineitem").where("l_linenumber <= 4").select(F.col("l_orderkey").alias("parent_id"), F.when(F.col("l_returnflag") == "R", "BLOCK_MISSING").otherwise("PASS").alias("decision"))
    return state.with_children(parents, children).groupBy("decision").agg(F.count("*").alias("units"), F.sum("id").alias("ids"))


@query
def assembly_decision(spark, sf):
    d = _decided(spark, sf)
    return state.assembly_decision(d.select((~F.col("decision").isin("BLOCK_MISSING", "BLOCK_STALE_TEXT")).alias("done"), F.lit(False).alias("failed"), F.col("decision").isin(*state.RELEASED).alias("record_ok")))


@query
def release_gate(spark, sf):
    return _decided(spark, sf).where(F.col("decision").startswith("BLOCK")).select("id", "decision")


@query
def retry_outcome(spark, sf):
    takes = table(spark, sf, "events")
    return state.outcome_of_attempts(takes.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", F.col("event_type") != "error", F.col("value") > 50).select("user_id", F.col("passed_attempt").cast("bigint").alias("passed_attempt"), "attempts", "structural_failures", "validation_failures")


@query
def verdict_reasons(spark, sf):
    """The ordered checks of the strict gate over per-user evidence."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    why = agg.reasons(coverage=F.col("n") < 8, mandatory=F.col("low") < 1, terminal=F.col("high") < 90, no_speech=F.col("low") > 20, logprob=F.col("high") > 99.5, repetition=F.col("n") >= 20)
    return e.select("user_id", F.when(F.size(why) == 0, "PASS").otherwise("FAIL").alias("verdict"), F.array_join(why, ",").alias("reasons"))


@query
def confidence_means(spark, sf):
    """Means of three scores over each order's segments, four places; a missing one counts as zero."""
    l = table(spark, sf, "lineitem")
    mean = lambda c: agg.mean_places(F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("bigint"), 2)
    return l.groupBy("l_orderkey").agg(mean(F.when(F.col("l_returnflag") != "A", F.col("l_discount"))).alias("logprob"), mean(F.col("l_tax")).alias("no_speech"), mean(F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))).alias("compression"))


@query
def context_chain(spark, sf):
    """Depths of turns as units of paragraphs of four, within conversations."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("para"), (F.char_length("text") % 9 != 0).alias("ok"))
    return state.context_depth(c, ["conv_id", "para"], "turn", F.col("ok")).select("conv_id", "turn", F.col("depth").cast("bigint").alias("depth"))


@query
def cache_misses(spark, sf):
    """Units whose content key no record has (records cover the first half of the ids)."""
    d = docs(spark, sf).select("doc_id", hashing.cache_key(F.lit("policy-1"), F.col("lang"), F.sha2("text", 256)).alias("key"))
    known = d.where("doc_id % 2 = 0").select("key").distinct()
    return d.join(known, "key", "left_anti").select("doc_id")


@query
def input_errors(spark, sf):
    p = docs(spark, sf).select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    actual = p.where("cast(path as bigint) % 9 <> 0").select("path", F.when(F.col("path").cast("bigint") % 7 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return files.input_errors(p, actual)


@query
def attempt_stream(spark, sf):
    """The streaming fold's batch form: attempts, failures and the last value of each user and day."""
    from tessera.streaming.attempts import attempt_counts

    return attempt_counts(table(spark, sf, "events")).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "attempts", "failures", F.round("last_value", 6).alias("last_value"))


# --- gates and resets -----------------------------------------------------------------


@query
def take_gates(spark, sf):
    """Each user's events as the boundaries of one take: none of the aligned ones may have failed."""
    failed = F.coalesce((F.col("value") > 1) & ~F.when(F.col("event_type") != "view", F.col("value") > 2), F.lit(False))
    e = table(spark, sf, "events").groupBy("user_id").agg(F.some(failed).alias("failed"), F.max("value").alias("high"))
    boundary = F.array(F.struct(F.lit(True).alias("aligned"), (~F.col("failed")).alias("passed")))
    return e.select("user_id", gates.take_passes(F.when(F.col("high") > 100, "PASS").otherwise("FAIL"), F.col("user_id") % 9 != 0, boundary).alias("passes"))


@query
def current_records(spark, sf):
    d = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    record = {"verdict": F.when(F.col("quality") == 1, "PASS"), "text_sha": F.sha2("text", 256), "wav_sha": F.when(F.col("doc_id") % 13 != 0, "w"), "policy": F.lit("p2"), "model": F.when(F.col("doc_id") % 3 != 0, "m").otherwise("old")}
    return d.select("doc_id", gates.record_ok(record, F.sha2("text", 256), F.lit("w"), "p2", "m").alias("ok"))


@query
def hard_gate_reasons(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("a"), F.min("l_tax").alias("b"), F.max("l_quantity").alias("c"), F.count("*").alias("n"))
    why = gates.hard_gates(F.col("a") * 7, F.col("b") * -60, F.when(F.col("n") > 2, F.col("c") / 20), F.when(F.col("n") == 7, 1).otherwise(0), F.lit(None).cast("double"))
    return l.select("l_orderkey", F.array_join(why, ",").alias("reasons"))


@query
def loop_repetitions(spark, sf):
    """Turns whose most repeated n-gram is a loop beside the turn before."""
    grams = ngram_repetition(spark, sf)
    # both lie by turn; merged, as tokens are estimated by their texts and would be broadcast
    rows = _dealt_turns(spark, sf).hint("merge").join(grams, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", gates.is_loop(F.col("max_multiplicity"), F.col("most_repeated"), F.col("expected"), 1).alias("loop"))


@query
def duration_gate(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment").agg(F.count_if(gates.duration_ok(F.col("o_totalprice"), F.lit(100000.0), F.when(F.col("c_acctbal") > 0, F.lit(300000.0)))).alias("within"), F.count("*").alias("units"))


@query
def child_units(spark, sf):
    l = table(spark, sf, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber")
    return gates.children(l, "l_orderkey", "l_linenumber").groupBy("id").agg(F.count("*").alias("n"), F.min("idx").alias("idx"))


@query
def regenerated(spark, sf):
    """Line units left after the orders of a status, and single lines, are asked for again."""
    units = table(spark, sf, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(":c"), F.col("l_linenumber").cast("string")).alias("id"))
    ids = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("id")).unionAll(units.where("id like '%:c2'"))
    return gates.reset(units, ids).groupBy("id").agg(F.count("*").alias("n"))


@query
def unknown_units(spark, sf):
    ids = table(spark, sf, "labels").select((F.col("doc_id") * 2).cast("string").alias("id"))
    return gates.unknown(ids, _plan(spark, sf))


@query
def promoted_failures(spark, sf):
    failed = _plan(spark, sf).where("idx % 3 = 0").select("id", "text_sha256", F.lit("w").alias("wav_sha256"))
    records = _done(spark, sf).select("id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"), "text_sha256", F.lit("w").alias("wav_sha256"))
    return gates.promoted(failed, records).select("id")


@query
def retry_errors(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 150, F.col("event_type")))).alias("r"))
    return e.select(F.md5(gates.failure_text(F.col("user_id"), F.col("r"))).alias("text_md5"))


@query
def name_set(spark, sf):
    """Distinct capitalised words by language, normalised."""
    names = docs(spark, sf).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]+"), F.lit(0))).alias("w")).select("lang", matching.bare_column(F.col("w")).alias("w"))
    return names.groupBy("lang").agg(F.countDistinct("w").alias("names"))


@query
def fragile_terms(spark, sf):
    """Bare numbers of at most two digits, and words with a digit or another odd character."""
    words = docs(spark, sf).select(F.explode(F.split("text", r"\s+")).alias("w")).select(matching.bare_column(F.col("w")).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"\d") | ~F.translate("w", "-", "").rlike(r"^\p{L}+$"))


@query
def validation_summary(spark, sf):
    d = _decided(spark, sf)
    return d.agg(F.count("*").alias("units"), F.count_if(F.col("decision") == "PASS").alias("passed"), F.count_if(F.col("decision").startswith("BLOCK")).alias("blocked"), F.count_if(F.col("record").isNull()).alias("without_record"))


@query
def excluded_units(spark, sf):
    """Decisions less the accepted ones."""
    d = _decided(spark, sf).select("id", "decision")
    return d.join(d.where(F.col("decision").isin(*state.RELEASED)).select("id"), "id", "left_anti").select("id")


@query
def batch_results(spark, sf):
    """Results of a batch by position; a position without one is an error."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_custkey")
    got = table(spark, sf, "lineitem").where("l_linenumber = 3").groupBy(F.col("l_orderkey").alias("pos")).agg(F.count("*").alias("results"))
    return o.join(got, "pos", "left").groupBy(F.when(F.col("results").isNull(), "missing").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


@query
def unit_identity(spark, sf):
    """Canonical-JSON hash of a unit's facts."""
    return docs(spark, sf).select("doc_id", hashing.identity(unit=F.col("doc_id"), lang=F.col("lang"), text_sha256=F.sha2("text", 256)).alias("identity"))


@query
def cached_metrics(spark, sf):
    """Word counts of texts: from records of the even ids where the text has one, computed for the rest."""
    d = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    cache = d.where("doc_id % 2 = 0").groupBy("key").agg(F.max(text.words(F.col("text"))).alias("words"))
    out = state.with_cache(d, cache, "key", lambda m: m.select("doc_id", "key", text.words(F.col("text")).alias("words")))
    return out.groupBy("cached").agg(F.count("*").alias("units"), F.sum("words").cast("bigint").alias("words"))


@query
def timed_tokens(spark, sf):
    """Canonical tokens with times from word segments; adjacent numbers are one token."""
    word = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (i * 0.3).alias("start"), (i * 0.3 + 0.2).alias("end")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", matching.timings_of(word).alias("t"))
    return rows.select("conv_id", "turn", F.size("t").alias("tokens"), F.try_element_at("t", F.lit(-1))["end"].alias("last_end"))


@query
def strict_verdict(spark, sf):
    """The ten checks of the strict gate over each order's lines as evidence."""
    l = table(spark, sf, "lineitem")
    flagged = lambda c: F.array_sort(F.collect_list(F.when(c, F.concat(F.lit("w"), F.col("l_linenumber").cast("string")))))  # noqa: E731  seven lines an order at most
    late = F.struct(F.col("l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, "colon_semicolon").when(F.col("l_linenumber") % 3 == 0, "comma").otherwise("sentence_end").alias("kind"), (F.col("l_tax") * 2).alias("gap_s"), F.lit(0.15).alias("threshold_s"), F.when(F.col("l_linenumber") != 5, F.col("l_tax") * 2 >= 0.15).alias("passed"))
    e = l.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("k"), flagged(F.col("l_returnflag") == "R").alias("missing"), flagged(F.col("l_quantity") > 48).alias("mandatory"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.max("l_quantity").alias("most"), F.array_sort(F.collect_list(F.when(F.col("l_discount") > 0.05, late))).alias("b"),
    )
    n, key = F.col("n"), F.col("l_orderkey")
    v = gates.verdict({
        "fraction": F.round(F.col("k") / n, 2), "matched_tokens": F.col("k"), "expected_tokens": n, "missing": F.col("missing"), "mandatory_missing": F.col("mandatory"), "terminal_expected": F.concat(F.lit("end of "), key.cast("string")), "terminal_matched": key % 7 != 0,
        "no_speech": F.when(n > 1, F.round(F.col("high") * 7, 2)), "logprob": F.round(F.col("low") * -30, 2), "compression": F.round(F.col("most") / 20, 2), "most_repeated": F.lit("thank you"), "multiplicity": n - 3, "gap_s": F.when(n != 4, F.round(F.col("low") * 60, 2)), "leakage_flagged": key % 11 == 0, "leakage_detail": F.lit("text of another"), "boundaries": F.col("b"),
    })
    return e.select("l_orderkey", v.alias("v")).select("l_orderkey", "v.verdict", F.array_join("v.reasons", " | ").alias("reasons"))


@query
def selected_units(spark, sf):
    """Chunks of the newest languages on, from a chapter to resume at, the first two hundred."""
    plan = docs(spark, sf).select(F.col("lang").alias("chapter"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("id"))
    chapters = sorted(r.chapter for r in plan.select("chapter").where("chapter is not null").distinct().collect())  # languages
    return planning.resume_units(plan, chapters, chapters[1], 200).select("id", "chapter")


@query
def eligible_clauses(spark, sf):
    """Spans of turns made of their words, some unusable, in order."""
    words = F.split("text", " ")
    spans = F.transform(F.slice(words, 1, F.least(F.size(words), F.lit(6))), lambda w, i: F.struct(F.when(i != 2, (F.lit(20) - 3 * i)).alias("start"), F.when(i % 4 != 3, F.lit(25) - 3 * i).alias("end"), F.when(i == 2, F.lit(1)).alias("source_start"), F.when(i == 3, F.lit(0)).alias("source_end"), F.when(i == 4, F.lit("  ")).when(i == 1, w).alias("text"), F.when(i == 5, F.lit(False)).alias("eligible")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", planning.eligible_clauses(spans, F.col("text")).alias("c"))
    return rows.select("conv_id", "turn", F.posexplode("c").alias("place", "c")).select("conv_id", "turn", "place", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.char_length("c.text").alias("chars"))


@query
def units_done(spark, sf):
    """Units of labelled documents that are really done."""
    plan, n = _plan(spark, sf), F.col("id").cast("bigint")
    done = _done(spark, sf).select("id", "text_sha256", (n % 23 == 0).alias("omitted"), F.when(n % 3 != 0, (n % 5) / 100.0).alias("tail_peak"), F.lit("w").alias("wav_sha256"), F.when(n % 13 != 0, "w").alias("actual_wav_sha256"), (F.col("quality") == 1).alias("take_passes"))
    return state.units_done(plan, done).groupBy("is_done").agg(F.count("*").alias("units"), F.sum(F.col("id").cast("bigint")).alias("ids"))


@query
def loaded_state(spark, sf):
    """A run forced over another plan's state: what is carried over, less failures that are resolved."""
    plan = _plan(spark, sf)
    done = plan.where("idx % 4 = 0").select("id", "text_sha256")
    failed = plan.where("idx % 6 = 0").select("id", "text_sha256").unionAll(plan.where("idx % 5 = 0").select(F.concat("id", F.lit(":c0001")).alias("id"), "text_sha256"))
    now, left, archive = state.loaded(done, failed, "conflict", True, force=True)
    each = now.select("id", F.lit("done").alias("kind")).unionAll(left.select("id", F.lit("failed").alias("kind")))
    return each.groupBy("kind").agg(F.count("*").alias("units"), F.countDistinct("id").alias("ids")).withColumn("archived", F.lit(archive))


@query
def recorded_outcomes(spark, sf):
    """Events as outcomes of users: the last one of each counts."""
    e = table(spark, sf, "events")
    out = e.select(F.col("user_id").cast("string").alias("id"), F.md5(F.col("user_id").cast("string")).alias("text_sha256"), (F.col("event_type") != "error").alias("passed"), F.array("event_type").alias("reasons"), F.struct("ts", "event_id").alias("at"))
    start = e.select(F.col("user_id").cast("string").alias("id")).distinct()
    done = start.where("cast(id as bigint) % 2 = 0").withColumn("text_sha256", F.lit("old"))
    failed = start.where("cast(id as bigint) % 3 = 0").select(F.concat("id", F.lit(":c0002")).alias("id"), F.lit("old").alias("text_sha256"), F.array(F.lit("x")).alias("reasons"))
    now, left = state.recorded(done, failed, out.where("event_id % 2 = 0"))
    return now.select("id", "text_sha256", F.lit("done").alias("kind")).unionAll(left.select("id", "text_sha256", F.lit("failed").alias("kind")))


@query
def workload_stats(spark, sf):
    """Orders as workers: seconds with and without the precompute, by candidate and mode."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.floor("o_totalprice").cast("double").alias("gen"), F.when(F.col("o_orderstatus") == "F", F.lit(1000.0)).alias("pre"))
    out = agg.workload_stats(o, "o_orderkey", "o_orderpriority", "gen", "pre")
    return out.select("o_orderpriority", "mode", "n", *[F.round(c, 3).alias(c) for c in ("median", "mean", "low", "high", "p10", "p90", "std")])


@query
def deltas_by_repeat(spark, sf):
    """Paired deltas as a column a candidate."""
    names = {"2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    wide = agg.pairs_by_repeat(_pairs(spark, sf), "repeat", "candidate", list(names))
    return wide.select("repeat", *[F.round(F.col(f"`{k}`"), 3).alias(v) for k, v in names.items()])


@query
def manifest_counts(spark, sf):
    return files.manifest(_decided(spark, sf))


@query
def failure_texts(spark, sf):
    """Why units failed validation, by what their records show."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 180, F.col("event_type")))).alias("r"), F.min("value").alias("low"))
    late = F.array(F.struct(F.when(F.col("user_id") % 2 == 0, "colon_semicolon").alias("kind"), (F.col("user_id") % 5 != 0).alias("aligned"), (F.col("low") > 2).alias("passed")))
    return e.select("user_id", gates.validation_failure(F.col("r"), F.lit("the end"), F.col("user_id") % 4 != 0, late).alias("why"))
