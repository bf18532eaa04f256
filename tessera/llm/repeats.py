"""Repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes (operator 8).

The result is what sorting all suffixes through their first ``width`` bytes would give: the groups of
equal prefixes are the repeated windows, and every byte under one is removed.  Sorting one row for
each byte would move hundreds of times the corpus, so each digit pass carries a run of suffixes:

* The *anchor* of a window is its lowest-hashed ``DIGIT``-byte string.  It depends on the window's
  bytes alone, so equal windows have their anchor at the same offset, and one anchor stands for a run
  of consecutive windows (some 80 of them).
* Pass 1 orders anchors by that string (the first digit).  Groups of one are singletons: all their
  windows are unique and leave, as in any radix sort.
* Pass 2 orders the rest by the fingerprint of the run's whole context.  Equal contexts repeat with
  all their windows.
* Pass 3 takes one text of each context that still shares a digit with a different context, deals
  the contexts' bytes by digit, and orders their windows by the fingerprint of the full ``width``
  bytes; equal groups are exactly the repeated windows.  Contexts of a digit that has over
  ``HOT_KINDS`` of them are not dealt: their windows are counted as rows of their own instead.

Digits are 64-bit hashes; contexts are compared by another 64 bits within a digit, windows by 128.  Every pass counts with map-side combination and joins the
counts back, so a passage in a third of all texts is one small row per task and a join that adaptive
execution may split.  Nothing is collected, capped or broadcast.

Rows: null texts count as empty; texts shorter than the window keep all bytes; repeated rows (even
with one doc_id) are separate texts and so repeat each other; very long texts are cut into
overlapping slices that share no window.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt_anew, map_arrow, mix64, row_slices, stored, string_buffers, text_key

#: Bytes of the first digit.
DIGIT = 32
SLICE = 1 << 20
#: Contexts compared at once in pass 3 (more only if one digit has more), and the most of one digit there.
GROUP_ROWS = 8_000
HOT_KINDS = 20_000
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    kept = _POWERS.get(which)
    if kept is None or len(kept[0]) < n:
        n = max(n, SLICE + 1024)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, _U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = kept = tuple(out)
    return kept


_BYTES = [mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407 + 2 * k)) for k in (0, 1)]


class Prints:
    """Fingerprints of any substring of a byte array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[at]) * self.down[at]

    def rolling(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


def _pieces(data: np.ndarray, offsets: np.ndarray, width: int):
    """(rows, start of the first within its text, bytes, offsets) so that each window is in one piece."""
    for a, b in row_slices(offsets, SLICE):
        if b - a == 1 and offsets[b] - offsets[a] > SLICE:
            start, n = int(offsets[a]), int(offsets[b] - offsets[a])
            for at in range(0, n - width + 1, SLICE - width + 1):
                part = data[start + at : start + min(n, at + SLICE)]
                yield a, at, part, np.array([0, len(part)])
        else:
            yield a, 0, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, first window, last window, anchor, digit hash)."""
    n = len(data)
    if n < width:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, e, e.astype(np.uint64), None
    prints = Prints(data, 0)
    h = mix64(prints.rolling(DIGIT))
    place = _U((1 << 22) - 1)
    key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    span = width - DIGIT + 1  # digits in a window
    step = 1
    while 2 * step <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if span > step:
        key = np.minimum(key[: -(span - step)], key[span - step :])
    at = (key & place).astype(np.int64)  # the anchor of the window that starts at each byte
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    valid = np.arange(len(at)) + width <= offsets[row + 1]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return starts, starts, starts, starts, h[:0], prints
    a, r = at[starts], row[starts]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    lo, hi = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    return r[new], lo, hi, a[new], h[a[new]], prints


def _digits(batch: pa.RecordBatch, width: int):
    """Pass 1: (digit, times in this batch)."""
    data, offsets = string_buffers(batch.column(0))
    for _, _, part, at in _pieces(data, offsets, width):
        digit = anchors(part, at, width)[4]
        values, times = np.unique(digit, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["digit", "n"])


def _runs(batch: pa.RecordBatch, width: int):
    """Pass 2: a row for each anchor, with the fingerprint of its context."""
    data, offsets = string_buffers(batch.column(0))
    r1, r2 = (np.asarray(batch.column(i)) for i in (1, 2))
    for first, shift, part, at in _pieces(data, offsets, width):
        row, lo, hi, a, digit, prints = anchors(part, at, width)
        if not len(row):
            continue
        shape = ((a - lo).astype(np.uint64) << _U(20)) | (hi - lo).astype(np.uint64)
        c1 = mix64(prints.of(lo, hi + width) + mix64(shape + _U(1)))
        begin = lo - at[row] + shift
        cols = [digit.view(np.int64), c1.view(np.int64), r1[first + row], r2[first + row], begin, (hi - lo).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["digit", "c1", "r1", "r2", "lo", "more"])


def _once(batches, fn, width: int):
    """fn over the first row of each text that a task meets; copies ask for the same and repeat anyway."""
    seen = set()
    for batch in batches:
        keys = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        rows = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        if rows:
            yield from fn(batch.take(pa.array(rows)), width)


def _contexts(batch: pa.RecordBatch, width: int):
    """Bytes of the contexts asked for in each text."""
    data, offsets = string_buffers(batch.column(0))
    for i in range(batch.num_rows):
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        digit, lo, more = (batch.column(k)[i].values for k in (3, 4, 5))
        at = np.asarray(lo)
        parts = [text[a : a + m + width] for a, m in zip(at.tolist(), more.to_pylist())]
        n = len(parts)
        yield pa.RecordBatch.from_arrays([digit, *(pa.array([batch.column(k)[i].as_py()] * n, pa.int64()) for k in (1, 2)), pa.array(at), pa.array(parts, pa.binary())], names=["digit", "r1", "r2", "lo", "bytes"])


def _sorted_groups(batches, width: int):
    """Pass 3 over rows sorted by digit: windows that two contexts of the same digit share, as runs."""
    held: list[pa.RecordBatch] = []

    def finish(rows: pa.Table):
        for part in rows.to_batches(max_chunksize=len(rows)):
            col = part.column(4).cast(pa.large_binary())
            offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            sizes = np.diff(offsets) - width + 1
            first = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.arange(int(sizes.sum())) - first[row]
            at = (offsets[:-1] - offsets[0])[row] + inside
            w1, w2 = Prints(data, 0).of(at, at + width), Prints(data, 1).of(at, at + width)
            order = np.lexsort((w2, w1))
            same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
            twice = np.zeros(len(order), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = np.flatnonzero(twice)
            if not len(hit):
                continue
            new = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])])
            lo, hi = hit[new], hit[np.r_[new[1:], len(hit)] - 1]
            r = row[lo]
            r1, r2, start = (np.asarray(part.column(k)) for k in (1, 2, 3))
            cols = [r1[r], r2[r], start[r] + inside[lo], (hi - lo).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["r1", "r2", "lo", "more"])

    n = 0
    for batch in batches:
        digit = np.asarray(batch.column(0))
        cuts = np.flatnonzero(digit[1:] != digit[:-1]) + 1
        at = 0
        if held and len(digit) and digit[0] != np.asarray(held[-1].column(0))[-1] and n >= GROUP_ROWS:
            yield from finish(pa.Table.from_batches(held).combine_chunks())
            held, n = [], 0
        for cut in [*cuts.tolist(), len(digit)]:
            if cut == len(digit) or n + cut - at >= GROUP_ROWS:
                held.append(batch.slice(at, cut - at))
                n += cut - at
                at = cut
                if cut < len(digit):
                    yield from finish(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
    if held:
        yield from finish(pa.Table.from_batches(held).combine_chunks())


def _windows(batch: pa.RecordBatch, width: int):
    """Pass 3: full-width fingerprints of the windows asked for, as runs (start, windows) of each text."""
    data, offsets = string_buffers(batch.column(0))
    r1, r2 = (np.asarray(batch.column(i)) for i in (1, 2))
    asked, more = batch.column(3), batch.column(4)
    for i in range(batch.num_rows):
        text = data[offsets[i] : offsets[i + 1]]
        lo, extra = np.asarray(asked[i].values, dtype=np.int64), np.asarray(more[i].values, dtype=np.int64)
        sizes = extra + 1
        cum = np.cumsum(sizes) - sizes
        s = np.repeat(lo - cum, sizes) + np.arange(int(sizes.sum()))
        s = np.unique(s)
        w1, w2 = [], []
        for at in range(0, len(s), SLICE // 8):
            part = s[at : at + SLICE // 8]
            # consecutive windows lie close together; cut where the bytes between would be many
            for run in np.split(part, np.flatnonzero(np.diff(part) > SLICE // 8) + 1):
                for sub in np.split(run, np.searchsorted(run, np.arange(run[0] + SLICE // 2, run[-1] + 1, SLICE // 2))):
                    if len(sub):
                        piece = text[sub[0] : sub[-1] + width]
                        w1.append(mix64(Prints(piece, 0).of(sub - sub[0], sub - sub[0] + width)))
                        w2.append(mix64(Prints(piece, 1).of(sub - sub[0], sub - sub[0] + width)))
        n = len(s)
        cols = [np.concatenate(w1).view(np.int64), np.concatenate(w2).view(np.int64), np.full(n, r1[i]), np.full(n, r2[i]), s]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["w1", "w2", "r1", "r2", "s"])


def _cut(batch: pa.RecordBatch, width: int):
    """Remove the covered bytes of each text: starts are windows (lo .. lo + more) that repeat."""
    ids, texts, lows, mores = (batch.column(i) for i in range(4))
    data, offsets = string_buffers(texts)
    n_bytes, removed, spans, digests = [], [], [], []
    for i in range(batch.num_rows):
        text = data[offsets[i] : offsets[i + 1]]
        n_bytes.append(len(text))
        if not lows[i].is_valid:
            removed.append(0)
            spans.append(0)
            digests.append(hashlib.sha256(text).hexdigest())
            continue
        lo = np.asarray(lows[i].values, dtype=np.int64)
        edge = np.zeros(len(text) + 1, dtype=np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + np.asarray(mores[i].values, dtype=np.int64) + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed.append(int(gone.sum()))
        spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
        digests.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
    yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *text_key(F.col(text_col)))


def repeated_runs(rows: DataFrame, width: int = 200) -> DataFrame:
    """(r1, r2, lo, more) from keyed rows: windows lo .. lo + more of the text with that key occur again somewhere."""
    texts = rows.select("text", "r1", "r2").where(F.octet_length("text") >= width)
    ctx, who = ["digit", "c1"], ["r1", "r2", "lo", "more"]

    digits = map_arrow(texts.select("text"), lambda b: _digits(b, width), "digit bigint, n bigint")
    digits = dealt_anew(digits.groupBy("digit").agg(F.sum("n").alias("n")).where("n > 1").select("digit"), "digit")
    runs = map_arrow(texts, lambda b: _runs(b, width), "digit bigint, c1 bigint, r1 bigint, r2 bigint, lo bigint, more int")
    # the changed digit hides the join's partitioning: counts by more columns are then dealt by all of
    # them, and the join stays free to split a digit that very many texts share
    runs = runs.join(digits, "digit", "left_semi").withColumn("digit", F.col("digit").bitwiseXOR(F.lit(1)))
    del digits
    # one row for each text and run, however often the text occurs
    runs = runs.groupBy(*ctx, *who).agg(F.count("*").alias("n"))
    runs = stored(runs)

    contexts = runs.groupBy(*ctx).agg(F.sum("n").alias("times"))
    shared = dealt_anew(contexts.where("times > 1").select(*ctx), *ctx)
    whole = runs.join(shared, ctx, "left_semi").select(*who)

    mixed = contexts.groupBy("digit").agg(F.count("*").alias("kinds")).where("kinds > 1")
    one_each = runs.groupBy(*ctx).agg(F.min(F.struct(*who)).alias("x"))
    asked = stored(one_each.join(mixed, "digit").select("digit", "kinds", "x.*"))

    def of_texts(asked: DataFrame) -> DataFrame:
        asked = asked.groupBy("r1", "r2").agg(F.collect_list(F.struct("digit", "lo", "more")).alias("q"))  # bounded by the text
        asked = asked.select("r1", "r2", *(F.col(f"q.{c}").alias(c) for c in ("digit", "lo", "more")))
        # all columns of rows, so that this join and that of remove_repeats read one shuffle of the texts
        return rows.join(asked, ["r1", "r2"]).select("text", "r1", "r2", "digit", "lo", "more", "doc_id")

    few = of_texts(asked.where(F.col("kinds") <= HOT_KINDS)).mapInArrow(lambda it: _once(it, _contexts, width), "digit bigint, r1 bigint, r2 bigint, lo bigint, bytes binary")
    few = few.repartition("digit").sortWithinPartitions("digit").mapInArrow(lambda it: _sorted_groups(it, width), "r1 bigint, r2 bigint, lo bigint, more int")
    if asked.where(F.col("kinds") > HOT_KINDS).isEmpty():
        return whole.unionByName(few)
    # a digit with very many contexts: its windows are counted one by one, with map-side combination
    windows = of_texts(asked.where(F.col("kinds") > HOT_KINDS)).select("text", "r1", "r2", "lo", "more")
    windows = stored(windows.mapInArrow(lambda it: _once(it, _windows, width), "w1 bigint, w2 bigint, r1 bigint, r2 bigint, s bigint"))
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"], "left_semi").select("r1", "r2", F.col("s").alias("lo"), F.lit(0).alias("more"))
    return whole.unionByName(few).unionByName(single)


def remove_repeats(docs: DataFrame, width: int = 200, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per input row: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes."""
    rows = keyed(docs, text_col, id_col)
    runs = repeated_runs(rows, width)
    runs = runs.groupBy("r1", "r2", "lo").agg(F.max("more").alias("more"))
    runs = runs.groupBy("r1", "r2").agg(F.collect_list(F.struct("lo", "more")).alias("q"))  # bounded by the text
    runs = runs.select("r1", "r2", F.col("q.lo").alias("lo"), F.col("q.more").alias("more"))
    rows = rows.join(dealt_anew(runs, "r1", "r2"), ["r1", "r2"], "left").select("doc_id", "text", "lo", "more")
    id_type = dict(docs.dtypes)[id_col]
    return map_arrow(rows, lambda b: _cut(b, width), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
