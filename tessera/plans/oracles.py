"""DuckDB SQL with the columns and rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from tessera.functions.matching import FUNCTION_WORDS

_SPACE = r"[\s\x0B\x85\p{Z}]+"
_T3 = f"""regexp_replace(translate(regexp_replace(trim(regexp_replace(raw, '{_SPACE}', ' ', 'g')), '\\s+[–—-]{{1,2}}\\s+', ', ', 'g'), '‘’', ''''''), '[“”"]', '', 'g')"""
LINES = f"""
raw_lines AS (SELECT doc_id, unnest(range(len(l))) AS para, unnest(l) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
marked_lines AS (SELECT doc_id, para, {_T3} AS t FROM raw_lines),
bare_lines AS (SELECT doc_id, para, CASE WHEN contains(t, '''') THEN array_to_string(list_transform(list_filter(range(1, length(t) + 1),
  lambda i: t[i] <> '''' OR (i > 1 AND regexp_matches(t[i - 1], '\\p{{L}}') AND regexp_matches(t[i + 1], '\\p{{L}}'))), lambda i: t[i]), '') ELSE t END AS t FROM marked_lines),
lines AS (SELECT doc_id, para, trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) AS text FROM bare_lines WHERE trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) <> '')"""
_SHORT = ", ".join(f"'{a}'" for a in "a.m. c. cf. dr. e.g. etc. fig. i.e. mr. mrs. ms. no. nos. p. p.m. pp. prof. st. vol. vs.".split())
# word by word: a word with a final mark ends a sentence unless it is short for something or the next begins small
SENTENCES = f"""
spaced AS (SELECT doc_id, para, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT doc_id, para, string_split(text, ' ') AS l FROM lines)),
parted AS (SELECT *, lead(w) OVER o AS nxt, regexp_extract(w, '([.!?]+)[)\\]]?$', 1) AS mark, regexp_extract(w, '^(.*?)[.!?]+[)\\]]?$', 1) || '.' AS stem FROM spaced WINDOW o AS (PARTITION BY doc_id, para ORDER BY i)),
ended AS (SELECT *, mark <> '' AND NOT (mark[1] = '.' AND (lower(stem) IN ({_SHORT}) OR regexp_full_match(stem, '(?:[A-Z]\\.)+'))) AS fin FROM parted),
put AS (SELECT *, coalesce(sum(CASE WHEN fin AND NOT regexp_matches(nxt, '^\\p{{Ll}}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM ended),
sentences AS (SELECT doc_id, para, pos, string_agg(w, ' ' ORDER BY i) AS sentence FROM put GROUP BY doc_id, para, pos)"""


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']*'))"


def spaced(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^\\s\\x0B\\x85\\p{{Z}}]+'))"


def tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def pad(c: str, n: int) -> str:
    return f"lpad({c}::VARCHAR, greatest({n}, length({c}::VARCHAR))::INT, '0')"


_NEW = "held >= 70 OR held + s.words > 85"
PLAN = f"""
WITH RECURSIVE {LINES}, {SENTENCES},
s AS (SELECT doc_id, para, pos, sentence, {words('sentence')} AS words, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id, para ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sentences),
r AS (SELECT doc_id, para, pos, 0 AS g, words AS held FROM s WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.para, s.pos, CASE WHEN {_NEW} THEN g + 1 ELSE g END, CASE WHEN {_NEW} THEN s.words ELSE held + s.words END FROM r JOIN s ON s.doc_id = r.doc_id AND s.para = r.para AND s.pos = r.pos + 1),
c AS (SELECT s.doc_id, s.para, g, min(s.pos) AS s0, max(s.pos) + 1 AS s1, min(start) AS start, sum(words)::BIGINT AS words, string_agg(sentence, ' ' ORDER BY s.pos) AS text FROM s JOIN r ON s.doc_id = r.doc_id AND s.para = r.para AND s.pos = r.pos GROUP BY s.doc_id, s.para, g),
e AS (SELECT *, start + length(text) AS "end" FROM c)
SELECT doc_id || ':p' || {pad('para', 4)} || ':s' || {pad('s0', 4)} || '-' || {pad('s1', 4)} || ':o' || {pad('start', 6)} || '-' || {pad('"end"', 6)} AS id, doc_id, para, s0, s1, start, "end", words, sha256(text) AS text_sha256 FROM e"""

_TURNS = f"""turns AS (SELECT conv_id, turn, {tokens('text')} AS heard, {tokens('before')} AS expected FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)"""
_VOCABULARY = f"""v AS (SELECT DISTINCT unnest({tokens('text')}) AS a FROM conversations), pairs AS (SELECT a, b FROM (SELECT a, lead(a) OVER (PARTITION BY a[1] ORDER BY a) AS b FROM v) WHERE b IS NOT NULL)"""


def skeleton(w: str) -> str:
    out = f"lower({w})"
    for a, b in (("ph", "f"), ("gh", "g"), ("ck", "k"), ("q", "k"), ("ce", "se"), ("ci", "si"), ("c", "k"), ("x", "ks")):
        out = f"replace({out}, '{a}', '{b}')"
    for letter in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"regexp_replace({out}, '{letter}{letter}+', '{letter}', 'g')"
    return f"(SELECT k[1] || regexp_replace(k[2:], '[aeiouy]', '', 'g') FROM (SELECT {out} AS k))"


_STOP = ", ".join(f"'{w}'" for w in sorted(FUNCTION_WORDS))
_KEPT = f"list_filter(t, lambda w: regexp_full_match(w, '[0-9]+') OR regexp_full_match(w, '[0-9]+0s') OR (regexp_full_match(w, '[a-z]{{6,}}') AND w NOT IN ({_STOP})))"
_STATS = ", ".join(f"round({e}, 3) AS {n}" for n, e in {"median": "quantile_cont(l_extendedprice, 0.5)", "mean": "avg(l_extendedprice)", "low": "min(l_extendedprice)", "high": "max(l_extendedprice)", "p10": "quantile_cont(l_extendedprice, 0.1)", "p90": "quantile_cont(l_extendedprice, 0.9)", "std": "stddev_pop(l_extendedprice)"}.items())
_PAIRS = """one AS (SELECT month(o_orderdate) AS repeat, o_orderpriority AS candidate, sum(floor(o_totalprice))::BIGINT AS value FROM orders GROUP BY ALL),
pairs AS (SELECT c.repeat, c.candidate, b.value AS base, c.value, (b.value - c.value) / nullif(b.value, 0)::DOUBLE * 100 AS delta FROM one c JOIN one b ON b.repeat = c.repeat AND b.candidate = '1-URGENT' WHERE c.candidate <> '1-URGENT')"""
_DONE = "done AS (SELECT doc_id, CASE WHEN toxic = 1 THEN sha256(text || 'x') ELSE sha256(text) END AS sha, quality, toxic FROM labels JOIN documents USING (doc_id))"
_DECIDED = f"""{_DONE}, u AS (SELECT d.doc_id AS idx, d.text, sha256(d.text) AS h, sha, quality FROM documents d LEFT JOIN done USING (doc_id)),
decided AS (SELECT idx, idx::VARCHAR AS id, CASE WHEN sha IS NULL THEN 'BLOCK_MISSING' WHEN sha <> h THEN 'BLOCK_STALE_TEXT' WHEN idx % 17 = 0 THEN 'BLOCK_STALE_WAV'
  WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'OMIT_UNSPEAKABLE' WHEN idx % 5 = 0 THEN 'BLOCK_UNVALIDATED' WHEN idx % 19 = 0 THEN 'BLOCK_STALE_VALIDATION' WHEN quality = 1 THEN 'PASS'
  WHEN idx % 7 = 0 OR idx % 3 = 0 THEN 'BLOCK_STRUCTURAL' WHEN idx % 2 = 0 THEN 'ALLOW_LEXICAL' WHEN idx % 11 < 5 AND idx % 4 > 0 THEN 'ALLOW_LEXICAL_NAME' ELSE 'BLOCK_LOW_COVERAGE' END AS decision FROM u)"""


def _grams(column: str) -> str:
    parts = [f"SELECT conv_id, turn, {n} AS size, i AS place, array_to_string({column}[i:i + {n - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len({column}) - {n - 2})) AS i FROM turns)" for n in (2, 3, 4)]
    return f"SELECT conv_id, turn, size, gram, count(*) AS n, min(place) AS place FROM ({' UNION ALL '.join(parts)}) GROUP BY conv_id, turn, size, gram"


_EMB = "list_transform(embedding, lambda v: v::DOUBLE)"
SQL = {
    "plan_chunks": PLAN,
    "typography_normalize": f"WITH {LINES} SELECT doc_id, para, length(text) AS chars, sha256(text) AS sha FROM lines",
    "word_counts_by_lang": f"SELECT lang, source, count(*) AS documents, sum({words('text')})::BIGINT AS words, sum({spaced('text')})::BIGINT AS spaced_words FROM documents GROUP BY ROLLUP (lang, source)",
    "sentence_split": f"WITH {LINES}, {SENTENCES} SELECT doc_id, para, pos, length(sentence) AS chars, {words('sentence')} AS words FROM sentences",
    "unspeakable_units": "SELECT doc_id, kind, count(*) AS unspeakable FROM (SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit FROM documents UNION ALL SELECT doc_id, 'word', unnest(regexp_split_to_array(text, '[ \\n]+')) FROM documents) WHERE NOT regexp_matches(unit, '[A-Za-z]') GROUP BY doc_id, kind",
    "merged_lines": """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS para, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), k AS (SELECT * FROM l WHERE trim(line) <> ''),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY para) AS before FROM k), m AS (SELECT *, CASE WHEN before IS NOT NULL AND NOT regexp_matches(before, '[.!?]["''’”)\\]]*$') AND regexp_matches(line, '^\\p{Ll}') THEN 0 ELSE 1 END AS new FROM b),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY para) - 1 AS part FROM m) SELECT doc_id, part::BIGINT AS part, count(*) AS pieces, (sum(length(line)) + count(*) - 1)::BIGINT AS chars FROM p GROUP BY doc_id, part""",
    "plan_relation": """WITH p AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents), o AS (SELECT * FROM p WHERE id <= (SELECT max(id) * 9 / 10.0 FROM p)), b AS (SELECT o.hash AS old, p.hash AS new FROM o FULL JOIN p USING (id)),
s AS (SELECT count(*) FILTER (old IS NOT NULL AND new IS NULL) AS lost, count(*) FILTER (old <> new) AS changed, count(*) FILTER (old IS NULL) AS added, 0::BIGINT AS moved FROM b)
SELECT *, CASE WHEN lost > 0 OR changed > 0 THEN 'conflict' WHEN added = 0 AND moved = 0 THEN 'match' ELSE 'superset' END AS relation FROM s""",
    "selected_chapters": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5)",
    "phonetic_skeletons": f"WITH w AS (SELECT DISTINCT unnest({tokens('p_name')}) AS word FROM part UNION SELECT DISTINCT unnest({tokens('text')}) FROM conversations) SELECT word, {skeleton('word')} AS skeleton FROM w",
    "levenshtein_candidates": f"WITH {_VOCABULARY} SELECT a, b, levenshtein(a, b) AS distance FROM pairs WHERE levenshtein(a, b) <= 2",
    "vowel_swap_pairs": f"WITH {_VOCABULARY}, d AS (SELECT a, b, list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i]) AS o FROM pairs WHERE length(a) = length(b) AND length(a) >= 4) SELECT a, b FROM d WHERE len(o) = 1 AND contains('aeiouy', a[o[1]]) AND contains('aeiouy', b[o[1]])",
    "phonetic_matches": f"WITH {_VOCABULARY}, k AS (SELECT a, b, {skeleton('a')} AS x, {skeleton('b')} AS y FROM pairs) SELECT a, b FROM k WHERE a <> b AND x <> '' AND y <> '' AND x[1] = y[1] AND (x = y OR (least(length(x), length(y)) >= 4 AND levenshtein(x, y) <= 1)) AND least(length(a), length(b)) >= 0.6 * greatest(length(a), length(b))",
    "attempt_seed": "SELECT o_orderkey, (1234567 + ('0x' || sha256(o_orderkey || ':2')[1:8])::BIGINT) % 4294967296 AS seed FROM orders",
    "content_identity": "SELECT doc_id, sha256(text) AS text_sha256, concat_ws('|', 'policy-1', lang, sha256(text)) AS cache_key FROM documents",
    "metadata_blocks": r"SELECT n_regionkey, regexp_replace(n_name || ' = 1; #', '([\\\n=;#])', '\\\1', 'g') AS escaped FROM nation",
    "mandatory_terms": f"WITH x AS (SELECT conv_id, turn, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]) AS t FROM (SELECT conv_id, turn, {tokens('text')} AS l FROM conversations)) SELECT conv_id, turn, len({_KEPT}) AS terms, coalesce(array_to_string({_KEPT}, ' '), '') AS all_terms FROM x",
    "ngram_repetition": f"""WITH {_TURNS}, h AS ({_grams('heard')}), e AS ({_grams('expected')}), o AS (SELECT h.*, row_number() OVER (PARTITION BY h.conv_id, h.turn ORDER BY h.n DESC, h.size, h.place) AS k, count(*) OVER (PARTITION BY h.conv_id, h.turn) AS repeated
FROM h LEFT JOIN e ON h.conv_id = e.conv_id AND h.turn = e.turn AND h.size = e.size AND h.gram = e.gram WHERE h.n > 1 AND h.n > coalesce(e.n, 0)) SELECT conv_id, turn, gram AS most_repeated, n AS max_multiplicity, repeated FROM o WHERE k = 1""",
    "leakage_overlap": f"""WITH d AS (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS w FROM documents), b AS (SELECT item_id, len(t) AS size, unnest(t) AS w FROM (SELECT item_id, list_distinct({tokens('text')}) AS t FROM benchmark))
SELECT doc_id, item_id, count(*) AS shared, size FROM d JOIN b USING (w) GROUP BY doc_id, item_id, size HAVING count(*) * 10 >= size * 8""",
    "turn_coverage": None,
    "signal_facts": f"""WITH f AS (SELECT vec_id, len(embedding) AS samples, round(sqrt(list_sum(list_transform({_EMB}, lambda v: v * v)) / len(embedding)), 4) AS rms, round(list_max(list_transform({_EMB}, lambda v: abs(v))), 4) AS peak,
round(len(list_filter({_EMB}, lambda v: abs(v) > 0.01)) / len(embedding), 4) AS active, len(list_filter({_EMB}, lambda v: abs(v) >= 1.0)) AS full_scale FROM embeddings)
SELECT *, concat_ws(',', CASE WHEN samples = 0 THEN 'empty' END, CASE WHEN NOT rms > 0.0001 THEN 'rms' END, CASE WHEN NOT active > 0.01 THEN 'active_ratio' END, CASE WHEN NOT peak < 1.0 THEN 'peak' END, CASE WHEN full_scale > 0 THEN 'full_scale' END) AS failed_gates FROM f""",
    "tail_and_quiet": f"""SELECT vec_id, round(list_max(list_transform({_EMB}[-8:], lambda v: abs(v))), 4) AS tail_peak, len(embedding) - coalesce(list_max(list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE) > 0.05)), 0) AS trailing,
coalesce(list_min(list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE) > 0.05)) - 1, len(embedding)) AS leading FROM embeddings""",
    "padded_codes": "SELECT vec_id, CASE WHEN len(embedding) = 0 THEN 0 ELSE ((len(embedding) + 24) // 25) * 25 END AS padded FROM embeddings",
    "gap_metrics": """WITH g AS (SELECT user_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events)
SELECT user_id, count(*) AS words, min(ts) AS first_start, max(ts) AS last_end, max(gap) AS max_gap_us, count(*) FILTER (gap > 3600000000) AS long_gaps FROM g GROUP BY user_id""",
    "assembly_offsets": """WITH u AS (SELECT conv_id, turn, turn // 2 AS para, length(text) * 1000 AS frames, length(text) % 7 * 500 AS lead_q, length(text) % 5 * 700 AS trail_q FROM conversations),
n AS (SELECT *, CASE WHEN lead(turn) OVER w IS NULL THEN 0 ELSE greatest(0, CASE WHEN lead(para) OVER w <> para THEN 12000 ELSE 6000 END - trail_q - lead(lead_q) OVER w) END AS silence_after FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, coalesce(sum(frames + silence_after) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_sample FROM n) SELECT conv_id, turn, silence_after, start_sample, start_sample + frames AS end_sample FROM s""",
    "chapter_rollup": """WITH p AS (SELECT n_nationkey, n_name, count(*) AS units, sum(floor(o_totalprice))::BIGINT AS frames FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT *, coalesce(sum(frames) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM p) SELECT n_nationkey, n_name, units, round_even(before * 1000 / 24000, 0)::BIGINT AS start_ms, round_even((before + frames) * 1000 / 24000, 0)::BIGINT AS end_ms FROM b""",
    "running_totals": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS audio_s, round(sum(l_discount) / nullif(sum(l_quantity), 0), 6) AS rtf FROM lineitem GROUP BY ALL",
    "eta_projection": f"WITH w AS (SELECT sum({spaced('text')})::BIGINT AS words FROM documents), a AS (SELECT words, words * 0.5::DOUBLE AS a FROM w) SELECT words, round(a, 1) AS audio_s, round(a * 1.5, 1) AS generation_s, round(a / 4, 1) AS asr_s, round(40 + a * 1.5 + a / 4, 1) AS total_s, round(round(a, 1) / 8, 1) AS remaining_s FROM a",
    "bench_stats": f"SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, {_STATS} FROM lineitem GROUP BY ALL",
    "bench_paired_delta": f"WITH {_PAIRS} SELECT repeat, candidate, base, value, round(delta, 3) AS delta FROM pairs",
    "bench_verdict": f"WITH {_PAIRS}, m AS (SELECT candidate, quantile_cont(delta, 0.5) AS d, count(*) AS repeats FROM pairs GROUP BY candidate) SELECT candidate, round(d, 3) AS median_delta, repeats, CASE WHEN max(d) OVER () >= 10 THEN 'improvement' WHEN max(d) OVER () <= -10 THEN 'regression' ELSE 'not_material' END AS verdict FROM m",
    "paired_orders": "SELECT o_orderpriority, repeat, ((o_orderpriority[1]::INT - 1 - (repeat - 1)) % 5 + 5) % 5 AS place FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT unnest([1, 2, 3]) AS repeat)",
    "pending_units": f"WITH {_DONE} SELECT d.doc_id::VARCHAR AS id, d.doc_id AS idx, coalesce(done.quality = 0, false) AS is_retry FROM documents d LEFT JOIN done USING (doc_id) WHERE done.sha IS NULL OR done.sha <> sha256(d.text)",
    "records_upsert": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "resolved_failures": "SELECT l_orderkey || ':c' || lpad(l_linenumber::VARCHAR, 4, '0') AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL",
    "adjudicate_decisions": f"WITH {_DECIDED} SELECT decision, count(*) AS units, sum(idx)::BIGINT AS ids FROM decided GROUP BY decision",
    "parent_fallback": """WITH c AS (SELECT l_orderkey AS id, bool_and(l_returnflag <> 'R') AS complete FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_orderkey),
d AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'PASS' WHEN complete THEN 'OMIT_PARENT_FALLBACK' WHEN complete IS NOT NULL THEN 'BLOCK_CHILD_INCOMPLETE' ELSE 'BLOCK_STRUCTURAL' END AS decision FROM orders LEFT JOIN c ON o_orderkey = c.id)
SELECT decision, count(*) AS units, sum(id)::BIGINT AS ids FROM d GROUP BY decision""",
    "assembly_decision": f"""WITH {_DECIDED}, s AS (SELECT count(*) AS units, 0::BIGINT AS failed, count(*) FILTER (decision IN ('BLOCK_MISSING', 'BLOCK_STALE_TEXT')) AS incomplete,
count(*) FILTER (decision NOT IN ('BLOCK_MISSING', 'BLOCK_STALE_TEXT', 'PASS', 'ALLOW_LEXICAL', 'ALLOW_LEXICAL_NAME')) AS blocked FROM decided)
SELECT *, CASE WHEN units = 0 THEN 'empty' WHEN failed > 0 THEN 'failed' WHEN incomplete > 0 THEN 'incomplete' WHEN blocked > 0 THEN 'blocked' ELSE 'release' END AS status FROM s""",
    "release_gate": f"WITH {_DECIDED} SELECT id, decision FROM decided WHERE decision LIKE 'BLOCK%'",
    "retry_outcome": """WITH t AS (SELECT user_id, row_number() OVER w - 1 AS attempt, event_type <> 'error' AS s, value > 50 AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, coalesce(sum((s AND NOT v)::INT) OVER w, 0) AS f, coalesce(max((s AND v)::INT) OVER w, 0) AS ok FROM t WINDOW w AS (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, max(CASE WHEN s AND v THEN attempt END) AS passed_attempt, count(*) AS attempts, count(*) FILTER (NOT s) AS structural_failures, count(*) FILTER (s AND NOT v) AS validation_failures FROM p WHERE attempt < 4 AND f < 2 AND ok = 0 GROUP BY user_id""",
    "verdict_reasons": """WITH e AS (SELECT user_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id), r AS (SELECT user_id, concat_ws(',', CASE WHEN n < 8 THEN 'coverage' END, CASE WHEN lo < 1 THEN 'mandatory' END, CASE WHEN hi < 90 THEN 'terminal' END,
CASE WHEN lo > 20 THEN 'no_speech' END, CASE WHEN hi > 99.5 THEN 'logprob' END, CASE WHEN n >= 20 THEN 'repetition' END) AS reasons FROM e) SELECT user_id, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS verdict, reasons FROM r""",
    "confidence_means": "WITH c AS (SELECT l_orderkey AS o, count(*) AS n, sum(CASE WHEN l_returnflag <> 'A' THEN round(l_discount * 100)::BIGINT ELSE 0 END) AS a, sum(round(l_tax * 100)::BIGINT) AS b, sum(CASE WHEN l_linenumber <> 2 THEN round(l_quantity * 100)::BIGINT ELSE 0 END) AS q FROM lineitem GROUP BY l_orderkey) SELECT o AS l_orderkey, floor((a * 200 + n) / (2 * n)) / 10000 AS logprob, floor((b * 200 + n) / (2 * n)) / 10000 AS no_speech, floor((q * 200 + n) / (2 * n)) / 10000 AS compression FROM c",
    # one unit after the other: what was kept of the one before, if it is of the same paragraph
    "context_chain": """WITH RECURSIVE c AS (SELECT conv_id, turn, turn // 4 AS para, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) % 9 <> 0 AS ok FROM conversations),
r AS (SELECT conv_id, turn, para, k, 0 AS depth, CASE WHEN ok THEN 0 END AS held FROM c WHERE k = 1 UNION ALL
  SELECT c.conv_id, c.turn, c.para, c.k, CASE WHEN r.held IS NOT NULL AND r.para = c.para THEN r.held + 1 ELSE 0 END,
    CASE WHEN c.ok AND (CASE WHEN r.held IS NOT NULL AND r.para = c.para THEN r.held + 1 ELSE 0 END) < 3 THEN (CASE WHEN r.held IS NOT NULL AND r.para = c.para THEN r.held + 1 ELSE 0 END) END FROM r JOIN c ON c.conv_id = r.conv_id AND c.k = r.k + 1)
SELECT conv_id, turn, depth::BIGINT AS depth FROM r""",
    "cache_misses": "SELECT doc_id FROM documents WHERE lang || '|' || sha256(text) NOT IN (SELECT lang || '|' || sha256(text) FROM documents WHERE doc_id % 2 = 0)",
    "input_errors": "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'differs' END AS problem FROM documents WHERE doc_id % 9 = 0 OR doc_id % 7 = 0",
    "attempt_stream": "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures, round(max_by(value, ts), 6) AS last_value FROM events GROUP BY ALL",
}
_BARE = "trim(lower(w), '.,;:!?()[]\"''-')"
SQL |= {
    "unit_identity": "SELECT doc_id, sha256(to_json({'lang': lang, 'text_sha256': sha256(text), 'unit': doc_id})::VARCHAR) AS identity FROM documents",
    "cached_metrics": f"SELECT sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS cached, count(*) AS units, sum({words('text')})::BIGINT AS words FROM documents GROUP BY ALL",
    "take_gates": "SELECT user_id, max(value) > 100 AND user_id % 9 <> 0 AND NOT bool_or(coalesce(value > 1 AND event_type <> 'view' AND NOT value > 2, false)) AS passes FROM events GROUP BY user_id",
    "current_records": "SELECT doc_id, coalesce(quality = 1 AND doc_id % 13 <> 0 AND doc_id % 3 <> 0, false) AS ok FROM documents JOIN labels USING (doc_id)",
    "hard_gate_reasons": """WITH l AS (SELECT l_orderkey, max(l_discount) AS a, min(l_tax) AS b, max(l_quantity) AS c, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, concat_ws(',', CASE WHEN a * 7 >= 0.6 THEN 'no_speech' END, CASE WHEN b * -60 < -1 THEN 'logprob' END, CASE WHEN n > 2 AND c / 20 > 2.4 THEN 'compression' END, CASE WHEN n = 7 THEN 'full_scale' END) AS reasons FROM l""",
    "loop_repetitions": "WITH " + _TURNS + ", g AS (" + SQL["ngram_repetition"] + """), j AS (SELECT g.conv_id, g.turn, max_multiplicity AS m, string_split(most_repeated, ' ') AS words, expected FROM g JOIN turns USING (conv_id, turn))
SELECT conv_id, turn, m > 1 AND len(list_filter(range(1, len(expected) - len(words) + 2), lambda i: expected[i:i + len(words) - 1] = words)) < m - 1 AS loop FROM j""",
    "duration_gate": "SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0 AND o_totalprice BETWEEN 100000 AND 300000) AS within, count(*) AS units FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "child_units": """WITH c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_quantity > 25)
SELECT l_orderkey || ':c' || lpad(k::VARCHAR, 4, '0') AS id, count(*) AS n, min(l_orderkey * 10000 + k) AS idx FROM c WHERE n > 1 GROUP BY ALL""",
    "regenerated": "SELECT l_orderkey || ':c' || l_linenumber AS id, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL",
    "unknown_units": "SELECT DISTINCT (doc_id * 2)::VARCHAR AS id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
    "promoted_failures": "SELECT doc_id::VARCHAR AS id FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 = 0 AND quality = 1 AND toxic <> 1",
    "retry_errors": "SELECT md5(user_id || ': every retry attempt failed: ' || coalesce(nullif(string_agg(DISTINCT event_type, '; ' ORDER BY event_type) FILTER (value > 150), ''), 'no diagnostic available')) AS text_md5 FROM events GROUP BY user_id",
    "name_set": f"SELECT lang, count(DISTINCT {_BARE}) AS names FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM documents) GROUP BY lang",
    "fragile_terms": f"WITH t AS (SELECT {_BARE} AS w FROM (SELECT unnest(regexp_split_to_array(text, '[\\s\\x0B]+')) AS w FROM documents)) SELECT w, count(*) AS n FROM t WHERE w <> '' AND (regexp_matches(w, '[0-9]') OR NOT regexp_full_match(replace(w, '-', ''), '\\p{{L}}+')) GROUP BY w",
    "validation_summary": f"WITH {_DECIDED} SELECT count(*) AS units, count(*) FILTER (decision = 'PASS') AS passed, count(*) FILTER (decision LIKE 'BLOCK%') AS blocked, count(*) FILTER (idx % 5 = 0) AS without_record FROM decided",
    "excluded_units": f"WITH {_DECIDED} SELECT id FROM decided WHERE decision NOT IN ('PASS', 'ALLOW_LEXICAL', 'ALLOW_LEXICAL_NAME')",
    "batch_results": "SELECT CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3) ON l_orderkey = o_orderkey GROUP BY ALL",
}
_STATS_OF = lambda c: ", ".join(f"round({e}, 3) AS {n}" for n, e in {"median": f"quantile_cont({c}, 0.5)", "mean": f"avg({c})", "low": f"min({c})", "high": f"max({c})", "p10": f"quantile_cont({c}, 0.1)", "p90": f"quantile_cont({c}, 0.9)", "std": f"stddev_pop({c})"}.items())
SQL |= {
    "strict_verdict": """WITH l AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'colon_semicolon' WHEN l_linenumber % 3 = 0 THEN 'comma' ELSE 'sentence_end' END AS kind, l_tax * 2 AS gap FROM lineitem),
e AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS k, round(count(*) FILTER (l_returnflag <> 'R') / count(*), 2) AS f,
  list(chr(39) || 'w' || l_linenumber || chr(39) ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS miss, list(chr(39) || 'w' || l_linenumber || chr(39) ORDER BY l_linenumber) FILTER (l_quantity > 48) AS mand,
  min(l_discount) AS lo, max(l_discount) AS hi, max(l_quantity) AS q,
  string_agg('sentence_end pause ' || printf('%.3f', gap) || 's < 0.150s', ' | ' ORDER BY l_linenumber, gap) FILTER (l_discount > 0.05 AND kind = 'sentence_end' AND gap < 0.15 AND l_linenumber <> 5) AS p1,
  string_agg('colon_semicolon pause ' || printf('%.3f', gap) || 's < 0.150s', ' | ' ORDER BY l_linenumber, gap) FILTER (l_discount > 0.05 AND kind = 'colon_semicolon' AND gap < 0.15 AND l_linenumber <> 5) AS p2 FROM l GROUP BY l_orderkey),
r AS (SELECT o, concat_ws(' | ', CASE WHEN f < 0.85 THEN 'coverage ' || printf('%.2f', f) || ' < 0.85 (matched ' || k || '/' || n || ', missing [' || coalesce(array_to_string(miss[1:5], ', '), '') || '])' END,
  CASE WHEN len(mand) > 0 THEN 'mandatory missing: [' || array_to_string(mand[1:5], ', ') || ']' END, CASE WHEN o % 7 = 0 THEN 'terminal phrase missing: ' || chr(39) || 'end of ' || o || chr(39) END,
  CASE WHEN n > 1 AND round(hi * 7, 2) >= 0.6 THEN 'no_speech_prob ' || printf('%.2f', round(hi * 7, 2)) || ' >= 0.6' END, CASE WHEN round(lo * -30, 2) < -1 THEN 'avg_logprob ' || printf('%.2f', round(lo * -30, 2)) || ' < -1.0' END,
  CASE WHEN round(q / 20, 2) > 2.4 THEN 'compression_ratio ' || printf('%.2f', round(q / 20, 2)) || ' > 2.4' END, CASE WHEN n - 3 >= 3 THEN 'repetition: n-gram ''thank you'' x' || (n - 3) END,
  CASE WHEN n <> 4 AND round(lo * 60, 2) > 2.5 THEN 'max internal gap ' || printf('%.2f', round(lo * 60, 2)) || 's > 2.5s' END, CASE WHEN o % 11 = 0 THEN 'text of another' END, p1, p2) AS reasons FROM e)
SELECT o AS l_orderkey, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS verdict, reasons FROM r""",
    "selected_units": "SELECT doc_id::VARCHAR AS id, lang AS chapter FROM documents WHERE lang > (SELECT min(lang) FROM documents) ORDER BY doc_id LIMIT 200",
    "eligible_clauses": """WITH s AS (SELECT conv_id, turn, text, string_split(text, ' ') AS ws FROM conversations), x AS (SELECT conv_id, turn, text, ws, unnest(range(least(len(ws), 6))) AS i FROM s),
y AS (SELECT conv_id, turn, text, ws, i, CASE WHEN i = 2 THEN 1 ELSE 20 - 3 * i END AS a, CASE WHEN i % 4 <> 3 THEN 25 - 3 * i WHEN i = 3 THEN 0 END AS z FROM x WHERE i <> 5),
t AS (SELECT conv_id, turn, a, z, CASE i WHEN 4 THEN '  ' WHEN 1 THEN ws[2] ELSE substring(text, a + 1, z - a) END AS t FROM y WHERE z > a)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY a, z, t) - 1 AS place, a AS start, z AS "end", length(t) AS chars FROM t WHERE trim(t) <> ''""",
    "units_done": f"""WITH {_DONE}, u AS (SELECT d.doc_id AS n, coalesce(sha = sha256(d.text) AND (d.doc_id % 23 = 0 OR (CASE WHEN d.doc_id % 3 <> 0 THEN d.doc_id % 5 / 100.0 ELSE 0 END <= 0.02 AND d.doc_id % 13 <> 0 AND quality = 1)), false) AS is_done FROM documents d LEFT JOIN done USING (doc_id))
SELECT is_done, count(*) AS units, sum(n)::BIGINT AS ids FROM u GROUP BY is_done""",
    "loaded_state": """WITH x AS (SELECT doc_id, 'done' AS kind, doc_id::VARCHAR AS id FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'failed', doc_id::VARCHAR FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0
UNION ALL SELECT doc_id, 'failed', doc_id || ':c0001' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 <> 0) SELECT kind, count(*) AS units, count(DISTINCT id) AS ids, true AS archived FROM x GROUP BY kind""",
    "recorded_outcomes": """WITH u AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) <> 'error' AS ok FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
d AS (SELECT user_id, 'old' AS t FROM u WHERE user_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, md5(user_id::VARCHAR) FROM l WHERE ok)
SELECT user_id::VARCHAR AS id, t AS text_sha256, 'done' AS kind FROM d UNION ALL SELECT user_id::VARCHAR, md5(user_id::VARCHAR), 'failed' FROM l WHERE NOT ok
UNION ALL SELECT user_id || ':c0002', 'old', 'failed' FROM u WHERE user_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM d)""",
    "workload_stats": f"""WITH w AS (SELECT o_orderpriority, floor(o_totalprice) AS g, CASE WHEN o_orderstatus = 'F' THEN 1000 ELSE 0 END AS p FROM orders), m AS (SELECT o_orderpriority, 'cold' AS mode, g + p AS s FROM w UNION ALL SELECT o_orderpriority, 'amortized', g FROM w)
SELECT o_orderpriority, mode, count(*) AS n, {_STATS_OF('s')} FROM m GROUP BY ALL""",
    "deltas_by_repeat": f"WITH {_PAIRS} SELECT repeat, " + ", ".join(f"round(max(delta) FILTER (candidate = '{k}'), 3) AS {v}" for k, v in {"2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}.items()) + " FROM pairs GROUP BY repeat",
    "manifest_counts": f"WITH {_DECIDED} SELECT decision, count(*) AS units, decision IN ('PASS', 'ALLOW_LEXICAL', 'ALLOW_LEXICAL_NAME') AS released FROM decided GROUP BY decision",
    "failure_texts": """WITH e AS (SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) FILTER (value > 180) AS r, min(value) AS lo FROM events GROUP BY user_id),
f AS (SELECT user_id, nullif(r, '') AS r, concat_ws('; ', CASE WHEN user_id % 4 = 0 THEN 'terminal phrase missing: ' || chr(39) || 'the end' || chr(39) END, CASE WHEN user_id % 5 <> 0 AND lo <= 2 THEN CASE WHEN user_id % 2 = 0 THEN 'colon_semicolon' ELSE 'punctuation' END || ' pause failed' END) AS w FROM e)
SELECT user_id, coalesce(r, nullif(w, ''), 'terminal or punctuation gate failed') AS why FROM f""",
}
SQL = {k: v for k, v in SQL.items() if v}
