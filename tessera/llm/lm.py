"""Text scoring by a hierarchical Pitman-Yor model (operator 4).

Every word of the training part that occurs before another is a context with a restaurant of its own,
and so is the start of a text; all restaurants share the unigram restaurant as parent.  The parent's
base measure never draws the same word twice: each known word has one table there, and the tables
still to come are the unknown words.  So for a context u

    P(w|u) = (c_uw - d1 t_uw + (s1 + d1 t_u) P(w)) / (s1 + c_u)
    P(w) = (t_w - d0) / (s0 + T),   P(unknown) = (s0 + d0 V) / (s0 + T)

with t_u, t_w and T the sums of the tables t_uw, which sums to one over the V known words and the
unknown one.  The tables come from blocked Gibbs sampling of the seating.  The weight of all seatings
with tables t is

    prod_u Gamma(s1/d1 + t_u) d1^t_u  x  prod_uw S(c_uw, t_uw)  x  prod_w Gamma(t_w - d0) / Gamma(s0 + T)

and two sets of auxiliary variables take its sums apart: p, the parent's masses, drawn from a Dirichlet
distribution with parameters t_w - d0 (and s0 + d0 V for the unknown), and g_u, drawn from a Gamma
distribution with shape s1/d1 + t_u.  Given them, all t_uw are independent, with weights
S(c, t) (d1 g_u p_w)^t.  A sweep reseats all customers of all pairs from these exact conditionals, then
draws p and g again.  When T has settled (``settled``), the conditional means of t_uw are averaged over the
last ``SAMPLES`` sweeps, and t_u, t_w and T are their sums.  Discounts d0, d1 are estimated from the counts of counts,
strengths are fixed.  The tables and the parent's probabilities are averaged apart from each other.

Every draw is a function of its words and sweep alone and sums are of integers, so neither the order of
rows nor blocks, tiles and partitions change a draw; a lost task repeats its draws.

Spread over executors: texts become blocks, a row of word numbers each, which is stored once; texts are
never dealt.  A block sends its distinct (word, context) pairs with their counts, compressed, to *tiles*
by word; very frequent words are split by context.  A pair of one customer has one table; only the
others take part in the sweeps, which are joins by word and by context.  At the end blocks send their
pairs once more, and a tile answers with bare arrays in the order it was asked.  Only sums over the
whole corpus and the list of split words (``MOST_SPLIT`` at most, 12 MB) reach the driver.

Words are 56-bit hashes of lower-cased (A-Z) tokens (of n distinct words, some n*n/2**57 pairs share one).  Rows: null and empty texts are one end token;
a null id counts as the empty text for the split; repeated rows are counted and scored each; very long
texts are scored whole; other columns are ignored.  Without training rows every word is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, give_back, mix64, row_slices, small_batches, stored, string_buffers
from tessera.llm.near import word_hashes

#: Bytes of text in a block, tokens to a tile.
BLOCK_BYTES, TILE_TOKENS = 4_000_000, 1_250_000
#: Sweeps at least before the sums may count as settled, and at most; settled sweeps that are averaged.
BURN, MOST_SWEEPS, SAMPLES = 1, 200, 2
STRENGTH = 1.0
#: Customers up to which the weights of table counts are tabulated.
EXACT = 1024
#: Mean tables t of a pair of n customers travel as (t - 1) / (n - 1) in this many steps.
STEPS = 65535
#: Words that are split over tiles, at most: those of a share of 1 / MOST_SPLIT or more.
MOST_SPLIT = 1 << 20
END = np.uint64(0x23456789ABCDEF)
#: The context of a text's first word.
START = np.uint64(0xDCBA9876543210)
_START = int(START.view(np.int64))


def held_out(id_col: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts == part


# --- numbers in bytes ---------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, compressed place by place."""
    x = np.ascontiguousarray(x)
    return _coder()[0].compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) if len(x) else b""


@lru_cache(maxsize=1)
def _coder():
    """One compressor and decompressor a process: making them costs more than most arrays here."""
    return zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()


def _array(blob: bytes, kind, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, dtype=kind)
    raw = _coder()[1].decompress(blob)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Numbers as differences: small for sorted ones, right for all."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _summed(blob: bytes, kind, n: int) -> np.ndarray:
    return np.cumsum(_array(blob, kind, n), dtype=kind)


# --- blocks ---------------------------------------------------------------------


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a column of texts, an end after each text; and the tokens of each text."""
    data, offsets = string_buffers(col)
    words, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for a, b in row_slices(offsets, 1 << 22):
        h, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        words.append(np.insert(h >> np.uint64(8), first[1:], END))
        counts.append(np.diff(first) + 1)
    return np.concatenate(words), np.concatenate(counts)


def _blocks(batches, id_type):
    """Texts (doc_id, train, text) as blocks of word numbers, the most frequent word first."""
    part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block():
        words, lengths, train = (np.concatenate([x[i] for x in held]) for i in range(3))
        names, number, count = np.unique(words, return_inverse=True, return_counts=True)
        order = np.lexsort((names, -count))
        place = np.empty(len(names), dtype=np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        ids = pa.concat_arrays([x[3] for x in held])
        return pa.record_batch({
            "block": pa.array([(part << 32) + at]), "tokens": pa.array([len(words)]), "kinds": pa.array([len(names)]), "train": pa.array([int(train.sum())]),
            "words": pa.array([_steps(names[order])]), "stream": pa.array([_planes(place[number])]), "lengths": pa.array([_planes(lengths)]), "learns": pa.array([_planes(train.astype(np.uint8))]),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        })

    for batch in small_batches(batches, 2, 1_000_000):
        words, lengths = tokens(batch.column(2))
        held.append((words, lengths, np.asarray(batch.column(1).fill_null(False)), batch.column(0)))
        size += int(batch.column(2).nbytes)
        if size >= BLOCK_BYTES:
            yield block()
            held, size, at = [], 0, at + 1
            give_back()
    if held:
        yield block()
    held.clear()
    give_back()


_BLOCKS = "block bigint, tokens bigint, kinds bigint, train bigint, words binary, stream binary, lengths binary, learns binary"


@dataclass
class Tiles:
    """How many tiles there are, and the words that are split (sorted) with their number of ways."""

    count: int
    split: np.ndarray
    ways: np.ndarray

    def home(self, word: np.ndarray) -> np.ndarray:
        return (mix64(word) % np.uint64(self.count)).astype(np.int64)

    def of(self, word: np.ndarray, context: np.ndarray, home: np.ndarray) -> np.ndarray:
        if not len(self.split):
            return home
        at = np.minimum(np.searchsorted(self.split, word), len(self.split) - 1)
        often = np.flatnonzero(self.split[at] == word)
        out = home.copy()
        out[often] = self.home(word[often] + mix64(context[often]) % self.ways[at[often]])
        return out


class Block:
    """A block's tokens, and its distinct pairs by (tile, word, context); words and contexts by rank of their hash."""

    def __init__(self, row: dict, tiles: Tiles):
        kinds, n = row["kinds"], row["tokens"]
        names = np.r_[_summed(row["words"], np.uint64, kinds), START]
        order = np.argsort(names)
        rank = np.empty(kinds + 1, dtype=np.int32)
        rank[order] = np.arange(kinds + 1, dtype=np.int32)
        self.tiles, self.names, self.start = tiles, names[order], int(rank[kinds])
        self.lengths = _array(row["lengths"], np.int64, len(row["ids"]))
        self.learns = _array(row["learns"], np.uint8, len(row["ids"])).astype(bool)
        self.words = rank[_array(row["stream"], np.int32, n)]
        self.contexts = np.empty_like(self.words)
        self.contexts[1:] = self.words[:-1]
        self.contexts[np.cumsum(self.lengths) - self.lengths] = self.start
        self.home = tiles.home(self.names)
        #: Words in the order of their homes.
        self.by_home = np.argsort(self.home, kind="stable")
        self.by_home = self.by_home[self.by_home != self.start]

    def _in_order(self, pair: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word, context and tile of sorted pairs, by tile; and their order."""
        w, u = (x.astype(np.int32) for x in np.divmod(pair, len(self.names)))
        tile = self.tiles.of(self.names[w], self.names[u], self.home[w])
        # sixteen bits are sorted by counting
        order = np.argsort(tile.astype(np.uint16) if self.tiles.count <= 1 << 16 else tile, kind="stable")
        return w[order], u[order], tile[order], order

    def _keys(self) -> np.ndarray:
        return self.words.astype(np.int64) * len(self.names) + self.contexts

    def counted(self) -> tuple[np.ndarray, ...]:
        """Word, context, tile and training count of each distinct pair."""
        learns = np.repeat(self.learns, self.lengths)
        key = np.sort(self._keys() * 2 + learns)
        edge = np.flatnonzero(np.diff(key >> 1, prepend=-1))
        *pairs, order = self._in_order(key[edge] >> 1)
        return *pairs, np.add.reduceat(key & 1, edge)[order].astype(np.int32) if len(edge) else edge.astype(np.int32)

    def numbered(self) -> tuple[np.ndarray, ...]:
        """Word and context of each distinct pair, in the same order, and the pair of each token."""
        key, pair = np.unique(self._keys(), return_inverse=True)
        w, u, _, order = self._in_order(key)
        back = np.empty(len(order), dtype=np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        return w, u, back[pair]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: col[i].as_py() if name != "ids" else col[i].values for name, col in zip(batch.schema.names, batch.columns)}


def _frequent(batches, least: int):
    """(w, n): words with n of each block's training tokens, where that is a share of 1 / least or more."""
    for row in _rows(batches):
        learns = np.repeat(_array(row["learns"], np.uint8, len(row["ids"])), _array(row["lengths"], np.int64, len(row["ids"])))
        n = np.bincount(_array(row["stream"], np.int32, row["tokens"]), weights=learns, minlength=row["kinds"]).astype(np.int64)
        often = np.flatnonzero(n * least >= max(1, int(learns.sum())))
        yield pa.record_batch({"w": pa.array(_summed(row["words"], np.uint64, row["kinds"])[often].view(np.int64)), "n": pa.array(n[often])})
        del learns, n, often
        give_back()


_PARCEL = "tile int, block bigint, kinds bigint, heads bigint, pairs bigint, words binary, per_word binary, contexts binary, context binary, n binary"


def _parcels(batches, tiles: Tiles):
    """A block's pairs, a row a tile: sorted words, pairs of each, sorted contexts, and each pair's context and training count."""
    for row in _rows(batches):
        b = Block(row, tiles)
        w, u, of, n = b.counted()
        split = np.flatnonzero(np.isin(b.names, tiles.split))
        at_home = b.home[split]
        out: list[tuple] = []
        for tile in np.union1d(of, at_home).tolist():
            at = slice(*np.searchsorted(of, [tile, tile + 1]))
            first = np.flatnonzero(np.diff(w[at], prepend=-1))  # pairs are sorted by word
            words, per = w[at][first], np.diff(np.r_[first, at.stop - at.start])
            if len(own := np.setdiff1d(split[at_home == tile], words)):  # split words are asked for at home, even without pairs there
                words, per = np.r_[words, own], np.r_[per, np.zeros(len(own), dtype=np.int64)]
                order = np.argsort(words)
                words, per = words[order], per[order]
            heads, head = np.unique(u[at], return_inverse=True)
            out.append((tile, row["block"], len(words), len(heads), len(head), _steps(b.names[words]), _planes(per.astype(np.int32)), _steps(b.names[heads]), _planes(head.astype(np.int32)), _planes(n[at])))
            if len(out) == 32:
                yield _parcel_rows(out)
                out = []
        if out:
            yield _parcel_rows(out)
        del b, w, u, of, n
        give_back()


def _parcel_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PARCEL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) if c == "tile" else pa.array(x) for c, x in zip(names, zip(*rows))], names=names)


# --- tiles ------------------------------------------------------------------------


class Tile:
    """The pairs of all parcels of a tile, sorted by word and context, with their training counts n."""

    def __init__(self, parcels: pa.Table):
        self.parcels = sorted(parcels.to_pylist(), key=lambda p: p["block"])
        own = [_summed(p["words"], np.uint64, p["kinds"]) for p in self.parcels]
        heads = [_summed(p["contexts"], np.uint64, p["heads"]) for p in self.parcels]
        self.words, self.heads = np.unique(np.concatenate(own)), np.unique(np.concatenate(heads))
        self.own = [np.searchsorted(self.words, w).astype(np.int32) for w in own]
        key, at = np.empty(sum(p["pairs"] for p in self.parcels), dtype=np.int64), 0
        for p, w, u in zip(self.parcels, self.own, heads):
            part = key[at : at + p["pairs"]]
            part[:] = np.repeat(w, _array(p["per_word"], np.int32, p["kinds"]))
            part *= len(self.heads)
            part += np.searchsorted(self.heads, u)[_array(p["context"], np.int32, p["pairs"])]
            at += p["pairs"]
        del own, heads
        order = np.argsort(key)
        key = key[order]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        self.w, self.u = (x.astype(np.int32) for x in np.divmod(key[edge], max(1, len(self.heads))))
        n = np.concatenate([_array(p["n"], np.int32, p["pairs"]) for p in self.parcels])
        self.n = np.add.reduceat(n[order].astype(np.int64), edge) if len(edge) else np.zeros(0, dtype=np.int64)
        self.order, self.edge = order, edge

    def numbers(self) -> np.ndarray:
        """The pair of each entry of the parcels."""
        out = np.empty(len(self.order), dtype=np.int32)
        out[self.order] = np.repeat(np.arange(len(self.edge), dtype=np.int32), np.diff(np.r_[self.edge, len(self.order)]))
        return out


_TILES = "tile int, kinds bigint, heads bigint, pairs bigint, twos bigint, words binary, word_n binary, word_ones binary, word_more binary, contexts binary, context_ones binary, context_more binary, w binary, u binary, n binary"


def _counted(parcels: pa.Table) -> pa.Table:
    """A tile in one row: its trained words and contexts with their pairs of one customer and of more, and the latter pairs."""
    t = Tile(parcels)
    sums = lambda at, of, m: np.bincount(at, weights=of, minlength=m).astype(np.int64)
    by_word, by_head = (sums(t.w, x, len(t.words)) for x in (t.n, t.n == 1, t.n > 1)), (sums(t.u, x, len(t.heads)) for x in (t.n == 1, t.n > 1))
    (w_n, w_ones, w_more), (u_ones, u_more) = by_word, by_head
    words, heads, more = np.flatnonzero(w_n), np.flatnonzero(u_ones + u_more), t.n > 1
    cols = {
        "tile": int(parcels.column("tile")[0].as_py()), "kinds": len(words), "heads": len(heads), "pairs": int(more.sum()), "twos": int((t.n == 2).sum()),
        "words": _steps(t.words[words]), "word_n": _planes(w_n[words]), "word_ones": _planes(w_ones[words]), "word_more": _planes(w_more[words]),
        "contexts": _steps(t.heads[heads]), "context_ones": _planes(u_ones[heads]), "context_more": _planes(u_more[heads]),
        "w": _steps(np.searchsorted(words, t.w[more]).astype(np.int32)), "u": _planes(np.searchsorted(heads, t.u[more]).astype(np.int32)), "n": _planes(t.n[more]),
    }
    del t, by_word, by_head
    give_back()
    return pa.table({k: pa.array([v], pa.int32()) if k == "tile" else pa.array([v]) for k, v in cols.items()})


_WORDS = "key bigint, n bigint, word_ones bigint, word_more bigint, context_ones bigint, context_more bigint"


def _marks(batches):
    """A tile's words and contexts as rows."""
    for r in _rows(batches):
        for kind, size, of in (("words", r["kinds"], ("word_n", "word_ones", "word_more")), ("contexts", r["heads"], ("context_ones", "context_more"))):
            key, given = _summed(r[kind], np.uint64, size), {c: _array(r[c], np.int64, size) for c in of}
            n, *rest = (given.get(c, np.zeros(size, dtype=np.int64)) for c in ("word_n", "word_ones", "word_more", "context_ones", "context_more"))
            for a in range(0, size, 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (key.view(np.int64), n, *rest)], names=["key", "n", "word_ones", "word_more", "context_ones", "context_more"])
        del key, given, n, rest
        give_back()


_PAIRS = "tile int, k int, u bigint, w bigint, n bigint"


def _pairs(batches):
    """A tile's pairs of several customers as rows; k numbers them."""
    for r in _rows(batches):
        m = r["pairs"]
        words, heads = _summed(r["words"], np.uint64, r["kinds"]).view(np.int64), _summed(r["contexts"], np.uint64, r["heads"]).view(np.int64)
        w, u, n = words[_summed(r["w"], np.int32, m)], heads[_array(r["u"], np.int32, m)], _array(r["n"], np.int64, m)
        for a in range(0, m, 100_000):
            part = slice(a, a + 100_000)
            k = np.arange(m, dtype=np.int32)[part]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r["tile"], dtype=np.int32)), pa.array(k), *(pa.array(x[part]) for x in (u, w, n))], names=["tile", "k", "u", "w", "n"])
        del words, heads, w, u, n
        give_back()


# --- the sampler --------------------------------------------------------------------


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on key and salt only."""
    h = key
    for x in salt:
        h = mix64(h + np.uint64((x * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
    return ((mix64(h) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """A Gamma variate of each shape, by squeezed normal variates; for shapes under one with a power of a uniform one."""
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c, out, left = 1 / np.sqrt(9 * a), np.empty(len(a)), np.arange(len(a))
    for i in range(1000):
        if not len(left):
            break
        k = key[left]
        x = np.sqrt(-2 * np.log(uniform(k, salt, 3 * i))) * np.cos(2 * np.pi * uniform(k, salt, 3 * i + 1))
        v = (1 + c[left] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(uniform(k, salt, 3 * i + 2)) < 0.5 * x * x + a[left] * (1 - v + np.log(v)))
        out[left[ok]] = (a[left] * v)[ok]
        left = left[~ok]
    return out * np.where(shape < 1, uniform(key, salt, -1) ** (1 / shape), 1)


def guess(n: np.ndarray) -> np.ndarray:
    """Tables of n customers to start from: near what those of a corpus settle at, so that few sweeps are needed."""
    return np.maximum(1, np.rint(n.astype(float) ** 0.5))


def settled(totals: list[float]) -> bool:
    """Whether the total tables of the sweeps so far hardly change (a tenth of sampling noise), or what is left of the change is under 0.05 percent.

    Steps that shrink by a factor r add up to r / (1 - r) times the last one.
    """
    if len(totals) < 3:
        return False
    step, before = abs(totals[-1] - totals[-2]), abs(totals[-2] - totals[-3])
    return step <= totals[-1] ** 0.5 / 10 or step < before and step * step / (before - step) <= totals[-1] / 2000


def auxiliary(kind: np.ndarray, key: np.ndarray, t: np.ndarray, d0: float, d1: float, sweep: int) -> np.ndarray:
    """The parent's mass of words (kind 0, to be divided by the sum of all) and the factor of contexts (kind 1)."""
    return gammas(np.where(kind == 0, t - d0, STRENGTH / d1 + t), key + kind.astype(np.uint64), sweep)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers."""
    x = np.asarray(x, dtype=float)
    y = x + 8
    shift = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


@lru_cache(maxsize=2)
def _ways(d: float) -> np.ndarray:
    """log S(n, t), the weight of all seatings of n customers at t tables with discount d, up to EXACT customers."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore"):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.log(np.maximum(n - d * t, 0)) + out[n, 1:])
    return out


def _saddle(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(n, t) by the saddle point of n! / t! [x^n] ((1 - (1 - x)^d) / d)^t, t < n; y = -log(1 - x)."""
    log_phi = lambda y: np.log(d) + np.log(-np.expm1(-y)) + (1 - d) * y - np.log(-np.expm1(-d * y))
    goal = np.log(n / t)
    low, high = np.full(goal.shape, 1e-12), (goal - np.log(d) + 2) / (1 - d)
    for _ in range(60):
        y = (low + high) / 2
        less = log_phi(y) < goal
        low, high = np.where(less, y, low), np.where(less, high, y)
    y = (low + high) / 2
    slope = 1 / np.expm1(y) + (1 - d) - d / np.expm1(d * y)
    log_v = goal + np.log(slope) + y + np.log(-np.expm1(-y))
    return _lgamma(n + 1.0) - _lgamma(t + 1.0) + t * np.log(-np.expm1(-d * y) / d) - n * np.log1p(-np.exp(-y)) - 0.5 * (np.log(2 * np.pi * t) + log_v)


@lru_cache(maxsize=2)
def _saddle_error(d: float) -> np.ndarray:
    """Error of _saddle at EXACT customers by t: it depends on t and hardly on n."""
    t = np.arange(1, EXACT // 2 + 1)
    return np.r_[0.0, _ways(d)[EXACT, t] - _saddle(np.full(len(t), float(EXACT)), t.astype(float), d)]


def tables(n: np.ndarray, log_a: np.ndarray, d: float, at: np.ndarray | None) -> np.ndarray:
    """Tables of n customers with weights S(n, t) a^t: the count that a uniform number at picks, or without it the mean.

    Beyond EXACT customers S is the calibrated saddle point, on a grid of 512 counts over all that have weight.
    """
    out = np.ones(len(n))
    top = 2
    while top // 2 < min(EXACT, int(n.max(initial=0))):
        width = min(top, EXACT)
        bucket = np.flatnonzero((n > top // 2) & (n <= width))
        t = np.arange(1, width + 1)
        for part in np.array_split(bucket, max(1, len(bucket) * width // 200_000)):
            weight = _ways(d)[n[part], 1 : width + 1] + log_a[part, None] * t
            weight = np.exp(weight - weight.max(axis=1, keepdims=True, initial=-np.inf))
            if at is None:
                out[part] = weight @ t / weight.sum(axis=1)
            else:
                cum = np.cumsum(weight, axis=1)
                out[part] = 1 + np.minimum((cum < (at[part] * cum[:, -1])[:, None]).sum(axis=1), n[part] - 1)
        top *= 2
    large = np.flatnonzero(n > EXACT)
    error = _saddle_error(d) if len(large) else None
    for part in np.array_split(large, max(1, len(large) // 200)):
        if not len(part):
            continue
        m, a = n[part, None].astype(float), log_a[part, None]

        def weight(t, m=m, a=a):
            return _saddle(m, t, d) + error[np.minimum(t, len(error) - 1).astype(int)] + t * a

        low, high = np.ones_like(m), m - 2  # the weight rises up to the mode
        for _ in range(int(np.log2(m.max())) + 2):
            mid = np.floor((low + high) / 2)
            up = weight(mid + 1) > weight(mid)
            low, high = np.where(up, np.minimum(mid + 1, high), low), np.where(up, high, mid)
        least, ends = weight(low) - 30, []
        for edge in (np.ones_like(m), m - 1):  # the weight falls by 30 between the mode and here
            x, y = low, edge
            for _ in range(int(np.log2(m.max())) + 2):
                mid = np.trunc((x + y) / 2)
                over = weight(mid) >= least
                x, y = np.where(over, mid, x), np.where(over, y, mid)
            ends.append(np.where(weight(y) >= least, y, x))
        step = np.ceil((ends[1] - ends[0] + 1) / 512)
        grid = ends[0] + np.arange(512) * step
        inside = grid <= m - 1
        grid = np.where(inside, grid, 1.0)
        y = np.where(inside, weight(grid), -np.inf)
        y = np.exp(y - y.max(axis=1, keepdims=True))
        if at is None:
            out[part] = (y * grid).sum(axis=1) / y.sum(axis=1)
        else:
            cum, x = np.cumsum(y, axis=1), at[part] * y.sum(axis=1)
            place = np.minimum((cum < x[:, None]).sum(axis=1), 511)
            row = np.arange(len(part))
            within = np.clip((x - cum[row, place]) / y[row, place] + 1, 0, 1)  # where in its grid cell the number lies
            out[part] = np.clip(grid[row, place] + np.floor((within - 0.5) * step[:, 0] + 0.5), 1, n[part])
    return out


def _gathered(batches, rows: int):
    """Batches together to so many rows or more; freed memory goes back at the end."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
    held.clear()
    give_back()


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(c)) for c in names]


def _drawn(batches, d1: float, log_norm: float, sweep: int):
    """New tables of pairs (u, w, n, p, g) as (kind, key, t): sums by word (kind 0) and context (1). Sweep 0: a first guess."""
    for table in _gathered(batches, 60_000):
        u, w, n = _columns(table, "u", "w", "n")
        if sweep:
            p, g = _columns(table, "p", "g")
            key = mix64(u.view(np.uint64)) + w.view(np.uint64)
            t = tables(n, np.log(d1) + np.log(g) + np.log(p) - log_norm, d1, uniform(key, sweep))
        else:
            t = guess(n)
        for kind, by in ((0, w), (1, u)):
            key, at = np.unique(by, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int8)), pa.array(key), pa.array(np.bincount(at, weights=t).astype(np.int64))], names=["kind", "key", "t"])


def _state(batches, d0: float, d1: float, sweep: int):
    """(kind, key, t) with the auxiliary variable x of each."""
    for batch in batches:
        kind, key, t = (np.asarray(batch.column(c)) for c in range(3))
        x = auxiliary(kind, key.view(np.uint64), t, d0, d1, sweep)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=["kind", "key", "t", "x"])
    give_back()


def _means(batches, d1: float, norms: list[float]):
    """Pairs (tile, k, u, w, n, p0, g0, p1, ...) with the mean s of their tables over the samples, in STEPS."""
    for table in _gathered(batches, 60_000):
        n = np.asarray(table.column("n"))
        each = [tables(n, np.log(d1) + np.log(g) + np.log(p) - norm, d1, None) for i, norm in enumerate(norms) for p, g in [_columns(table, f"p{i}", f"g{i}")]]
        share = np.rint((sum(each) / len(each) - 1) / (n - 1) * STEPS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("tile", "k", "u", "w")), pa.array(n.astype(np.int32)), pa.array(share)], names=["tile", "k", "u", "w", "n", "s"])


# --- scores -------------------------------------------------------------------------


@dataclass
class Model:
    """Sums over the training part."""

    tokens: int
    words: int
    d0: float
    d1: float
    tables: float
    start: tuple[int, float]  # customers and tables of the start of texts

    def unknown(self) -> float:
        return (STRENGTH + self.d0 * self.words) / (STRENGTH + self.tables)


def _homes(batches, tiles: Tiles):
    for batch in batches:
        home = tiles.home(np.asarray(batch.column("key")).view(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], names=["tile", *batch.schema.names])


_ANSWER = "block bigint, tile int, pairs bigint, words bigint, n binary, t binary, word_n binary, word_t binary, context_t binary"


def _answers(parcels: pa.Table, known: pa.Table, tiles: Tiles) -> pa.Table:
    """To each parcel: counts and tables of its pairs, and of the words at home here their counts, tables and tables as contexts."""
    names = ["block", "tile", "pairs", "words", "n", "t", "word_n", "word_t", "context_t"]
    if not parcels.num_rows:
        return pa.table({c: pa.array([], pa.int32() if c == "tile" else pa.int64() if i < 4 else pa.binary()) for i, c in enumerate(names)})
    tile = Tile(parcels)
    k, key, n, t, c_t = _columns(known, "k", "key", "n", "t", "context_t")
    more = np.flatnonzero(tile.n > 1)
    shares = np.zeros(len(tile.n), dtype=np.uint16)
    shares[more[k[k >= 0]]] = n[k >= 0]
    mine = np.flatnonzero(k < 0)
    mine = mine[np.argsort(key[mine].view(np.uint64))]
    at = np.searchsorted(key[mine].view(np.uint64), tile.words)
    there = np.flatnonzero(at < len(mine))
    there = there[key[mine].view(np.uint64)[at[there]] == tile.words[there]]
    word_n, word_t, context_t = np.zeros(len(tile.words), np.int64), np.zeros(len(tile.words), np.float32), np.zeros(len(tile.words), np.float32)
    word_n[there], word_t[there], context_t[there] = (x[mine][at[there]] for x in (n, t, c_t))
    here = tiles.home(tile.words) == int(parcels.column("tile")[0].as_py())
    out, first, number = [], 0, tile.numbers()
    for p, own in zip(tile.parcels, tile.own):
        pair = number[first : first + p["pairs"]]
        first += p["pairs"]
        own, c = own[here[own]], tile.n[pair]
        out.append((p["block"], p["tile"], len(pair), len(own), _planes(c.astype(np.int32)), _planes(shares[pair][c > 1]), _planes(word_n[own]), _planes(word_t[own]), _planes(context_t[own])))
    answer = pa.table([pa.array(x, pa.int32() if c == "tile" else None) for x, c in zip(zip(*out), names)], names=names)
    del tile, number, out, shares
    give_back()
    return answer


def _score(blocks: pa.Table, answers: pa.Table, m: Model, tiles: Tiles) -> pa.Table:
    out = []
    for row in _rows(blocks.to_batches()):
        b = Block(row, tiles)
        pair_w, pair_u, pair = b.numbered()
        got = sorted(answers.to_pylist(), key=lambda a: a["tile"])
        n = np.concatenate([_array(a["n"], np.int32, a["pairs"]) for a in got])
        t = (n > 0).astype(float)
        share = np.concatenate([_array(a["t"], np.uint16, int((_array(a["n"], np.int32, a["pairs"]) > 1).sum())) for a in got])
        t[n > 1] = 1 + share / STEPS * (n[n > 1] - 1)
        count, seats, own = np.zeros(len(b.names), np.int64), np.zeros(len(b.names)), np.zeros(len(b.names))
        for into, name, kind in ((count, "word_n", np.int64), (seats, "word_t", np.float32), (own, "context_t", np.float32)):
            into[b.by_home] = np.concatenate([_array(a[name], kind, a["words"]) for a in got])
        p = np.where(count > 0, (seats - m.d0) / (STRENGTH + m.tables), m.unknown())
        base = np.log10((count + 1) / (m.tokens + m.words + 1))
        known = count > 0
        customers = count.astype(float)
        customers[b.start], own[b.start] = m.start
        score = np.log10((n - m.d1 * t + (STRENGTH + m.d1 * own[pair_u]) * p[pair_w]) / (STRENGTH + customers[pair_u]))
        docs = len(b.lengths)
        doc = np.repeat(np.arange(docs), b.lengths)
        total = lambda x, of, doc=doc, docs=docs: np.bincount(doc, weights=x[of], minlength=docs)
        cols = [row["ids"], pa.array(~b.learns), pa.array(b.lengths), pa.array(total(known, b.words).astype(np.int64)), pa.array(np.full(docs, m.tokens)), pa.array(total(base, b.words)), pa.array(total(score, pair))]
        out.append(pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        del b, pair_w, pair_u, pair, n, t, got
        give_back()
    return pa.concat_tables(out)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """A row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The sums of a corpus settle in a few sweeps (its tables are many); a small model, whose few tables hang
    together closely and hide slow changes in noise, may be given more of them by burn.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (~held_out(F.col(id_col))).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    blocks = stored(rows.mapInArrow(lambda it: _blocks(it, id_type), f"{_BLOCKS}, ids array<{id_type}>"))
    size, learned = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    count = max(1, -(-size // TILE_TOKENS))
    least = min(2 * count, MOST_SPLIT)
    often = blocks.mapInArrow(lambda it: _frequent(it, least), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") * least >= size).collect()
    often = sorted((r.w % 2**64, -(-r.n * least // max(1, size))) for r in often)
    tiles = Tiles(count, np.array([w for w, _ in often], dtype=np.uint64), np.array([n for _, n in often], dtype=np.uint64))

    def parcels() -> DataFrame:
        return blocks.mapInArrow(lambda it: _parcels(it, tiles), _PARCEL)

    counted = stored(parcels().groupBy("tile").applyInArrow(_counted, _TILES))
    names = [c.split()[0] for c in _WORDS.split(", ")]
    words = stored(counted.mapInArrow(_marks, _WORDS).groupBy("key").agg(*[F.sum(c).alias(c) for c in names[1:]]))
    kinds = F.col("word_ones") + F.col("word_more")
    zero = lambda c: F.coalesce(c, F.lit(0))
    of = words.agg(*[zero(c).alias(n) for n, c in {"tokens": F.sum("n"), "words": F.count_if(F.col("n") > 0), "ones": F.sum("word_ones"), "more": F.sum("word_more"), "once": F.count_if(kinds == 1), "twice": F.count_if(kinds == 2), "still": F.sum(F.when(F.col("word_more") == 0, F.col("word_ones"))), "still_words": F.count_if((F.col("n") > 0) & (F.col("word_more") == 0))}.items()]).first()
    twos = counted.agg(zero(F.sum("twos"))).first()[0]
    d0, d1 = _discount(of.once, of.twice), _discount(of.ones, twos)

    # tables of the pairs of several customers; those of one have one table
    pairs = counted.mapInArrow(_pairs, _PAIRS)
    side = lambda kind, what: words.where(f"{what}_more > 0").select(F.lit(kind).cast("tinyint").alias("kind"), "key", F.col(f"{what}_ones").alias("t"))
    single = side(0, "word").unionAll(side(1, "context"))
    # the pairs needn't be sorted to meet a word's or a context's value
    by = lambda state, kind, key, value: state.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("x").alias(value)).hint("shuffle_hash")
    states, norms, totals, sweep = [], [], [], -1
    while of.more and not (sweep >= burn + samples - 1 and settled(totals)):
        sweep += 1
        if sweep > max(MOST_SWEEPS, burn + samples):
            raise RuntimeError(f"the tables have not settled after {sweep} sweeps: {totals[-5:]}")
        given = pairs.select("u", "w", "n")
        if sweep:
            given = given.join(by(states[-1], 0, "w", "p"), "w").join(by(states[-1], 1, "u", "g"), "u")
        drawn = given.mapInArrow(lambda it, s=sweep, n=norms[-1] if norms else 0.0: _drawn(it, d1, n, s), "kind tinyint, key bigint, t bigint")
        summed = drawn.unionAll(single).groupBy("kind", "key").agg(F.sum("t").alias("t"))
        state = stored(summed.mapInArrow(lambda it, s=sweep: _state(it, d0, d1, s), "kind tinyint, key bigint, t bigint, x double"))
        # the sum of all masses: integers, so that their order doesn't matter; of words without such pairs and the unknown in one
        mass, total = state.where("kind = 0").agg(F.sum(F.floor(F.col("x") * 65536)), F.sum("t")).first()
        rest = np.array([of.still - d0 * of.still_words, STRENGTH + d0 * of.words])
        norms.append(float(np.log(mass / 65536 + gammas(rest[rest > 0], np.arange(2, dtype=np.uint64)[rest > 0], sweep).sum())))
        totals.append(float(total + of.still))
        if len(states) >= samples:
            discard(states.pop(0))
        states.append(state)
    if states:
        flat = reduce(DataFrame.unionAll, [s.select("kind", "key", "x", F.lit(i).alias("i")) for i, s in enumerate(states)])
        flat = flat.groupBy("kind", "key").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"x{i}") for i in range(len(states))])
        of_kind = lambda kind, key, to: flat.where(F.col("kind") == kind).select(F.col("key").alias(key), *[F.col(f"x{i}").alias(f"{to}{i}") for i in range(len(states))]).hint("shuffle_hash")
        seats = pairs.join(of_kind(0, "w", "p"), "w").join(of_kind(1, "u", "g"), "u").mapInArrow(lambda it: _means(it, d1, norms[-samples:]), "tile int, k int, u bigint, w bigint, n int, s int")
    else:
        seats = pairs.select("tile", "k", "u", "w", F.col("n").cast("int").alias("n"), F.lit(0).alias("s"))
    seats = stored(seats)
    discard(counted, *states)

    mean = 1 + F.col("s") / STEPS * (F.col("n") - 1)
    extra = lambda key, name: seats.groupBy(F.col(key).alias("key")).agg(F.sum(mean).alias(name))
    known = words.join(extra("w", "more"), "key", "left").join(extra("u", "less"), "key", "left")
    known = known.select("key", "n", (F.col("word_ones") + F.coalesce("more", F.lit(0.0))).alias("t"), (F.col("context_ones") + F.coalesce("less", F.lit(0.0))).alias("context_t"))
    known = stored(known.mapInArrow(lambda it: _homes(it, tiles), "tile int, key bigint, n bigint, t double, context_t double"))
    discard(words)
    start = known.where(F.col("key") == _START).first()
    model = Model(of.tokens, of.words, d0, d1, float(known.agg(zero(F.sum("t"))).first()[0]), (learned, start.context_t if start else 0.0))
    none = lambda c, kind: F.lit(0).cast(kind).alias(c)
    told = known.select("tile", F.lit(-1).alias("k"), "key", "n", F.col("t").cast("float").alias("t"), F.col("context_t").cast("float").alias("context_t"))
    told = told.unionAll(seats.select("tile", "k", none("key", "bigint"), F.col("s").cast("bigint").alias("n"), none("t", "float"), none("context_t", "float")))
    answers = stored(parcels().groupBy("tile").cogroup(told.groupBy("tile")).applyInArrow(lambda p, k: _answers(p, k, tiles), _ANSWER))
    discard(seats, known)
    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda b, a: _score(b, a, model, tiles), schema)
