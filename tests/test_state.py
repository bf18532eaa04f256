"""State, plans, gates, sources and the streaming fold on small cases."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, signal
from tessera.operators import aggregates, planning, state
from tessera.sources import config, files, markup
from tessera.streaming import attempts


@pytest.mark.parametrize(
    "old,new,want",
    [
        ([("a", "1", 0), ("b", "2", 1)], [("a", "1", 0), ("b", "2", 1)], "match"),
        ([("a", "1", 0)], [("a", "1", 0), ("b", "2", 1)], "superset"),
        ([("a", "1", 0)], [("a", "9", 0)], "conflict"),
        ([("a", "1", 0), ("b", "2", 1)], [("a", "1", 0)], "conflict"),
    ],
)
def test_plan_relation(spark, old, new, want):
    frame = lambda x: spark.createDataFrame(x, "id string, hash string, pos int")
    assert planning.plan_relation(frame(old), frame(new)).first().relation == want


def test_selection():
    known = ["preface"] + [f"ch{i:02d}" for i in range(1, 10)]
    assert planning.parse_selection("1-3,preface", known) == ["preface", "ch01", "ch02", "ch03"]
    assert planning.parse_selection("09", known) == ["ch09"] and planning.parse_selection("", known) == known
    for bad in ("ch99", "5-2"):
        with pytest.raises(ValueError):
            planning.parse_selection(bad, known)


def test_pending_order(spark):
    plan = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("c", "3", 2), ("d", "4", 3)], "id string, text_sha256 string, idx int")
    done = spark.createDataFrame([("a", "1"), ("b", "old")], "id string, text_sha256 string")
    failed = spark.createDataFrame([("b",), ("c",)], "id string")
    assert [r.id for r in state.pending(plan, done, failed).collect()] == ["d", "b", "c"]


def test_resolved_failures(spark):
    failed = spark.createDataFrame([("p1",), ("p1:c0001",), ("p10:c0001",), ("p2",)], "id string")
    left = state.without_resolved(failed, spark.createDataFrame([("p1",)], "id string"))
    assert sorted(r.id for r in left.collect()) == ["p10:c0001", "p2"]


def test_context_depth(spark):
    """By hand: a chain counts 0, 1, 2, 3; one of depth 3 and one not usable pass nothing on; a paragraph starts anew."""
    rows = [("c", 0, i, ok) for i, ok in enumerate([True, True, True, True, False, True])] + [("c", 1, i, ok) for i, ok in enumerate([False, True, True, None, True], 6)] + [("c", 2, i, True) for i in range(11, 20)]
    df = spark.createDataFrame(rows, "chapter string, para int, idx int, ok boolean")
    got = state.context_depth(df, ["chapter", "para"], "idx", F.col("ok")).orderBy("idx").collect()
    assert [r.depth for r in got] == [0, 1, 2, 3, 0, 0] + [0, 0, 1, 2, 0] + [0, 1, 2, 3, 0, 1, 2, 3, 0]


def test_offsets(spark):
    rows = [("c", 0, 0, 100, 0, 0), ("c", 1, 0, 50, 1200, 0), ("c", 2, 1, 10, 1200, 0)]
    u = spark.createDataFrame(rows, "ch string, i int, para int, frames bigint, leading bigint, trailing bigint")
    got = aggregates.assembly_offsets(u, "ch", "i", "para", "frames", "leading", "trailing").orderBy("i").collect()
    assert [r.silence_after for r in got] == [4800, 10800, 0]
    assert [(r.start_sample, r.end_sample) for r in got] == [(0, 100), (4900, 4950), (15750, 15760)]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double").withColumn("k", F.lit(1))
    r = aggregates.stats(df, ["k"], "v").first()
    assert (r.n, r.median, r.mean, r.low, r.high) == (3, 2.0, 2.0, 1.0, 3.0)
    d = spark.range(1).select(aggregates.delta_percent(F.lit(2.0), F.lit(1.0)).alias("a"), aggregates.delta_percent(F.lit(4.0), F.lit(6.0)).alias("b"), aggregates.delta_percent(F.lit(0.0), F.lit(6.0)).alias("c")).first()
    assert (d.a, d.b, d.c) == (50.0, -50.0, None)


def test_signals(spark):
    x = [0.0] * 10 + [0.5, -0.6] + [0.0] * 5
    df = spark.createDataFrame([(x,), ([],)], "x array<double>")
    c = F.col("x")
    a, b = df.select(signal.trailing_quiet(c).alias("t"), signal.leading_quiet(c).alias("l"), signal.peak(c).alias("p"), signal.tail_peak(c, 6).alias("k"), signal.rms(c).alias("r"), F.size(hashing.padded_to(c, 25)).alias("n")).collect()
    assert (a.t, a.l, a.p, a.k, a.n) == (5, 10, 0.6, 0.6, 25) and (b.t, b.p, b.k, b.r, b.n) == (0, 0.0, 0.0, 0.0, 0)
    assert signal.sibilant_share([0.1] * 9000, "the monarch") is None and signal.sibilant_share([0.1] * 9000, "voices") is not None
    assert len(signal.resampled([0.0, 1.0, 0.0] * 100, 24000)) == 200 and signal.speech_share([]) == 0.0


def test_markup_and_archives(spark, tmp_path):
    assert markup.parse("<h2>Title<br/>Line two</h2><p>Opening prose.</p>") == {"heading": "Title Line two", "paragraphs": ["Opening prose."]}
    assert markup.parse("<p>a<sup>1</sup> b<a href='notes.html#n1'>*</a></p><script>x</script>")["paragraphs"] == ["a b"]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
        z.writestr("O/b.opf", '<package><metadata><dc:title xmlns:dc="x">T &amp; U</dc:title></metadata><manifest><item id="a" href="ch1.html"/><item id="b" href="preface.html"/><item id="c" href="cover.html"/></manifest><spine><itemref idref="b"/><itemref idref="c"/><itemref idref="a"/></spine></package>')
        for n, t in (("ch1", "One."), ("preface", "Pre."), ("cover", "x")):
            z.writestr(f"O/{n}.html", f"<h1>{n}</h1><p>{t}</p>")
    (tmp_path / "b.epub").write_bytes(box.getvalue())
    assert markup.read_metadata(box.getvalue())["title"] == "T & U"
    rows = markup.read_books(spark, str(tmp_path / "*.epub"))
    assert [(r.chapter, r.text) for r in rows.orderBy("spine_pos").collect()] == [("preface", "Pre."), ("ch01", "One.")]
    assert [r.chapter for r in markup.missing_chapters(rows, ["ch01", "ch02"]).collect()] == ["ch02"]


def test_files(spark, tmp_path):
    data = struct.pack("<4h", 0, 16384, -32768, 0)
    wav = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 24000, 48000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
    (tmp_path / "a.wav").write_bytes(wav)
    r = files.read_wavs(spark, str(tmp_path / "a.wav")).first()
    assert r.samples == [0.0, 0.5, -1.0, 0.0] and r.sample_rate == 24000 and files.parse_wav(b"x" * 50) is None
    (tmp_path / "r.json").write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b"}\n')
    assert [x.id for x in files.read_records(spark, str(tmp_path / "r.json"), "id string, n int").orderBy("id").collect()] == ["a", "b"]
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    (tmp_path / "ids.txt").write_text(" b \n\na\nb\n")
    assert [x.id for x in files.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("place").collect()] == ["b", "a"]
    for name, body in (("l.json", '[{"id": "a", "n": 1}, {"id": "b"}]'), ("o.json", '{"v": 2, "chunks": [{"id": "a", "n": 1}, {"id": "b"}]}')):
        (tmp_path / name).write_text(body)
        assert [tuple(x) for x in files.read_specs(spark, str(tmp_path / name), "id string, n int").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "x.json").write_text('{"chunks": 3}')
    with pytest.raises(Exception, match="specifications"):
        files.read_specs(spark, str(tmp_path / "x.json"), "id string, n int").collect()
    d = spark.createDataFrame([("b", None, "PASS", ["x"]), ("a", None, "BLOCK_MISSING", [])], "id string, parent_id string, decision string, detail array<string>")
    files.append_ledger(d, str(tmp_path / "ledger"))
    files.append_ledger(d, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4
    files.write_manifest(d, str(tmp_path / "manifest"))
    assert [x.id for x in spark.read.json(str(tmp_path / "manifest" / "excluded")).collect()] == ["a"]
    assert [(x.decision, x.units, x.released) for x in spark.read.json(str(tmp_path / "manifest" / "counts")).orderBy("decision").collect()] == [("BLOCK_MISSING", 1, False), ("PASS", 1, True)]
    ch = spark.createDataFrame([(1, "A = 1", 0, 5), (0, "B", 5, 9)], "i int, title string, start_ms int, end_ms int")
    assert files.chapter_metadata(ch, "i").first().text.startswith("[CHAPTER]\nTIMEBASE=1/1000\nSTART=5\nEND=9\ntitle=B\n[CHAPTER]") and "title=A \\= 1" in files.chapter_metadata(ch, "i").first().text


def test_config(tmp_path):
    (tmp_path / "project.toml").write_text(f'[book]\npath = "in/b.epub"\nsha = "{"a" * 64}"\nn = 3\nflag = true\nbad = "../x"\n')
    c = config.load_config(config.find_root(tmp_path))
    assert c.path("book", "path") == tmp_path / "in/b.epub" and c.number("book", "n") == 3 and c.digest("book", "sha")
    for call in (lambda: c.number("book", "flag"), lambda: c.path("book", "bad"), lambda: c.digest("book", "path"), lambda: c.text("book", "none")):
        with pytest.raises(config.ConfigError):
            call()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    attempts.run_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = attempts.attempt_counts(events)
    assert out.count() > 0 and out.exceptAll(batch).count() == 0  # days past the watermark, exactly as in batch


def test_load_and_record(spark):
    """Resume, refuse, carry over and discard; outcomes move units between done and failed."""
    done = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, text_sha256 string")
    failed = spark.createDataFrame([("a:c0001", "x", ["r"]), ("c", "3", ["r"])], "id string, text_sha256 string, reasons array<string>")
    ids = lambda df: sorted(r.id for r in df.collect())
    now, left, archive = state.loaded(done, failed, "superset", True)
    assert ids(now) == ["a", "b"] and ids(left) == ["c"] and not archive
    for relation, same in (("conflict", True), ("match", False)):
        with pytest.raises(ValueError):
            state.loaded(done, failed, relation, same)
        now, left, archive = state.loaded(done, failed, relation, same, force=True)
        assert ids(now) == ["a", "b"] and ids(left) == ["c"] and archive
        now, left, archive = state.loaded(done, failed, relation, same, discard=True)
        assert ids(now) == ids(left) == [] and archive
    outcomes = spark.createDataFrame([("c", "3", False, ["again"], 1), ("c", "3", True, None, 2), ("b", "2", False, ["late"], 3), ("d", "4", False, ["x"], 1)], "id string, text_sha256 string, passed boolean, reasons array<string>, at int")
    more = failed.unionAll(spark.createDataFrame([("c:c0002", "y", ["r"])], failed.schema))
    now, left = state.recorded(done, more, outcomes)
    assert ids(now) == ["a", "c"] and {r.id: r.reasons for r in left.collect()} == {"b": ["late"], "d": ["x"]}


def test_selection_of_units(spark):
    plan = spark.createDataFrame([("p", 0, "p0"), ("ch01", 1, "a"), ("ch02", 3, "c"), ("ch02", 2, "b")], "chapter string, idx int, id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(planning.select_units(plan, None, 3)) == ["a", "b", "p0"] and ids(planning.select_units(plan, ["ch02"])) == ["b", "c"]
    assert ids(planning.resume_units(plan, ["p", "ch01", "ch02"], "ch01", 2)) == ["a", "b"]
    with pytest.raises(ValueError):
        planning.select_units(plan, None, -1)
    with pytest.raises(ValueError):
        planning.resume_units(plan, ["p"], "ch09")


def test_waiver(spark):
    """A low log probability alone is made up for by a transcript that is the text, word for word."""
    one = lambda **k: {"text": "The End, again.", "text_sha256": "t", "done_sha": "t", "omitted": False, "wav": "w", "wav_sha": "w", "actual_wav_sha": "w", "record": 1, "record_sha": "t", "record_wav_sha": "w", "policy_ok": True, "model_ok": True, "take_passes": False, "verdict": "FAIL", "structural_ok": False, "lenient": 0.9, "all_fragile": False, "n_missing": 0, "only_logprob": True, "transcript": "the end again"} | k
    rows = [one(), one(transcript="the end"), one(only_logprob=False), one(transcript=None)]
    got = state.decisions(spark.createDataFrame(rows)).collect()
    assert [r.decision for r in got] == ["ALLOW_LEXICAL", "BLOCK_STRUCTURAL", "BLOCK_STRUCTURAL", "BLOCK_STRUCTURAL"]


def test_verdict(spark):
    from tessera.operators import gates

    kinds = "fraction double, matched_tokens int, expected_tokens int, missing array<string>, mandatory_missing array<string>, terminal_expected string, terminal_matched boolean, no_speech double, logprob double, compression double, most_repeated string, multiplicity int, gap_s double, leakage_flagged boolean, leakage_detail string, boundaries array<struct<kind:string,gap_s:double,threshold_s:double,passed:boolean>>"
    good = [0.96, 24, 25, [], [], "as it ended", True, 0.01, -0.2, 1.1, None, 1, 0.4, False, None, [("comma", 0.0, None, False), ("sentence_end", 0.2, 0.15, True), ("colon_semicolon", None, 0.1, None)]]
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    change = lambda **k: [k.get(n, v) for n, v in zip(names, good)]
    rows = [
        (good, []), (change(no_speech=None, logprob=None, compression=None, gap_s=None), []), (change(fraction=0.5, missing=list("abcdefg")), ["coverage 0.50 < 0.85 (matched 24/25, missing ['a', 'b', 'c', 'd', 'e'])"]),
        (change(mandatory_missing=["x"]), ["mandatory missing: ['x']"]), (change(terminal_matched=False, no_speech=0.6), ["terminal phrase missing: 'as it ended'", "no_speech_prob 0.60 >= 0.6"]),
        (change(logprob=-1.25, compression=2.5), ["avg_logprob -1.25 < -1.0", "compression_ratio 2.50 > 2.4"]), (change(most_repeated="a b", multiplicity=3, gap_s=2.75), ["repetition: n-gram 'a b' x3", "max internal gap 2.75s > 2.5s"]),
        (change(leakage_flagged=True, leakage_detail="seen"), ["seen"]), (change(boundaries=[("parenthetical_comma", 0.0, 0.075, False), ("sentence_end", 0.1, 0.15, False)]), ["sentence_end pause 0.100s < 0.150s", "parenthetical_comma pause 0.000s < 0.075s"]),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], f"i int, {kinds}")
    got = df.select("i", gates.verdict({n: F.col(n) for n in names}).alias("v")).orderBy("i").collect()
    assert [(r.v.verdict, r.v.reasons) for r in got] == [("FAIL" if want else "PASS", want) for _, want in rows]


def test_estimates(spark):
    pilot = {"audio_s_per_word": 0.5, "tokens_per_audio_s": 12.0, "generation_s_per_token": 0.1, "asr_rtf": None, "load_s": 3.0}
    e = aggregates.estimate(F.lit(101), pilot)
    r = spark.range(1).select(*[c.alias(k) for k, c in e.items()], aggregates.remaining_seconds(F.lit(10.0), F.lit(None).cast("double")).alias("left")).first()
    assert (r.audio_s, r.generation_s, r.asr_s, r.total_s, r.left) == (50.5, 60.6, None, 63.6, None)
    with pytest.raises(ValueError):
        aggregates.estimate(F.lit(1), pilot | {"tokens_per_audio_s": None})
