"""Token counts by rank-synchronous merging of ragged symbol arrays (operator 2).

The vocabulary is a byte-pair model with byte fallback, read through its library as a plain list of
pieces and scores (tokenizers are used, never trained).  No piece joins a non-space to a following
space mark, so a text falls into units ``spaces + non-spaces`` whose merges never interact.  Units
are counted once per batch: all distinct units lie end to end in numpy arrays, and every step
applies the best-ranked (then leftmost) pair of every unit at once, until no unit has a pair left.
A symbol outside the vocabulary counts as its UTF-8 bytes.

Rows: null texts count as empty; empty texts have no tokens; repeated rows are each counted; very
long texts are cut into units like any other, and a unit of over ``LONG_UNIT`` symbols is merged by
a heap, which keeps its cost near linear.  Other columns of the input pass through untouched.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LONG_UNIT = 400
#: Distinct units kept by a worker between batches; the store is emptied when full.
CACHE_UNITS = 800_000
NO_PAIR = np.int64(1) << 40


class PieceModel:
    """Pieces and scores of a byte-pair model as pair tables."""

    def __init__(self, pieces: list[str], scores: list[float]):
        order = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a space mark; units would interact")
        self.ids = {p: i for i, p in enumerate(pieces)}
        for c in sorted({c for p in pieces for c in p} - set(self.ids)):  # symbols that only occur inside pieces
            self.ids[c] = len(self.ids)
        self.known = len(pieces)
        pairs = {}
        for p, s in zip(pieces, scores):
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = (order[s], self.ids[p])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        # id of each code point; one outside the vocabulary is minus its UTF-8 length
        points = np.arange(0x110000)
        self.points = -(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.points[ord(c)] = i

    @staticmethod
    def load(path: str) -> "PieceModel":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return PieceModel([m.id_to_piece(i) for i in normal], [m.get_score(i) for i in normal])

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_PAIR if none) and the symbol it makes."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NO_PAIR), np.where(hit, self.into[at], -1)

    def symbols(self, text: str) -> np.ndarray:
        """Ids of a text's characters; one outside the vocabulary is minus its UTF-8 length."""
        return self.points[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)

    def size(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each final symbol stands for; only-inside symbols fall back to bytes."""
        out = np.where(symbols < 0, -symbols, 1)
        inner = symbols >= self.known
        if inner.any():
            names = {i: len(c.encode()) for c, i in self.ids.items() if i >= self.known}
            out[inner] = [names[i] for i in symbols[inner].tolist()]
        return out

    def count_units(self, units: list[str]) -> list[int]:
        """Tokens of each unit."""
        counts = np.zeros(len(units), dtype=np.int64)
        short = []
        for i, u in enumerate(units):
            if len(u) > LONG_UNIT:
                counts[i] = self.count_long(u)
            else:
                short.append(i)
        step = 10_000
        for at in range(0, len(short), step):
            part = short[at : at + step]
            counts[part] = self._count_short([units[i] for i in part])
        return counts.tolist()

    def _count_short(self, units: list[str]) -> np.ndarray:
        lengths = np.array([len(u) for u in units], dtype=np.int64)
        counts = np.zeros(len(units), dtype=np.int64)
        sym = self.symbols("".join(units))
        row = np.repeat(np.arange(len(units)), lengths)
        rank = np.full(len(sym), NO_PAIR)
        into = np.full(len(sym), -1, dtype=np.int64)
        inner = np.flatnonzero(row[:-1] == row[1:]) if len(row) else row
        rank[inner], into[inner] = self.find(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat((rank << 22) | np.arange(len(sym)), starts)  # lowest rank, then leftmost
            done = (best >> 22) == NO_PAIR
            if done.any():
                ends = np.r_[starts[1:], len(sym)]
                over = np.repeat(done, ends - starts)
                np.add.at(counts, row[over], self.size(sym[over]))
                best, keep = best[~done], ~over
                moved = np.cumsum(keep) - 1
                sym, row, rank, into = sym[keep], row[keep], rank[keep], into[keep]
                if not len(sym):
                    break
                at = moved[best & ((1 << 22) - 1)]
            else:
                at = best & ((1 << 22) - 1)
            sym[at] = into[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            sym, row, rank, into = sym[keep], row[keep], rank[keep], into[keep]
            for left in (moved - 1, moved):  # only the pairs beside a merge change
                left = left[(left >= 0) & (left + 1 < len(sym))]
                same = row[left] == row[left + 1]
                r, m = self.find(sym[left], sym[left + 1])
                rank[left], into[left] = np.where(same, r, NO_PAIR), m
            last = moved[moved == len(sym) - 1]
            rank[last] = NO_PAIR
        return counts

    def count_long(self, unit: str) -> int:
        sym = self.symbols(unit).tolist()
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.pairs.get
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (hit := get((sym[i] << 20) | sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], j, sym[j], hit[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, j, b, m = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], alive[j] = m, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return int(self.size(np.array([s for s, a in zip(sym, alive) if a], dtype=np.int64)).sum())


class Counter:
    """Tokens of texts, with a bounded store of units already counted."""

    def __init__(self, model: PieceModel):
        self.model, self.store = model, {}

    def _units(self, text: str) -> list[str]:
        """Units without their first mark (that of the text's start is added by the model)."""
        text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in UNIT.findall(MARK + text.replace(" ", MARK))]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self._units(t) if t else [] for t in texts]
        store = self.store
        if len(store) > CACHE_UNITS:
            store.clear()
        new = list({u for units in split for u in units if u not in store})
        store.update(zip(new, self.model.count_units([MARK + u for u in new])))
        get = store.__getitem__
        return [sum(map(get, units)) for units in split]


def token_counts(df: DataFrame, model_path: str, text_col: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens") -> DataFrame:
    """Append the UTF-8 length and the token count of text_col; an existing column of those names is replaced."""
    model = PieceModel.load(model_path)  # bounded by the vocabulary; travels with the function
    kept = [f for f in df.schema.fields if f.name not in (bytes_col, tokens_col)]
    inner = df.select(*[f"`{f.name}`" for f in kept])
    place = inner.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{bytes_col}` bigint", f"`{tokens_col}` bigint"])

    def run(batches):
        counter = Counter(model)
        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(place)), 0)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, base + 4_000_000)))
                part = batch.slice(at, end - at)
                n_tokens = counter.counts([t or "" for t in part.column(place).to_pylist()])
                n_bytes = pc.fill_null(pc.binary_length(part.column(place)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n_bytes, pa.array(n_tokens, pa.int64())], names=[*(f.name for f in kept), bytes_col, tokens_col])
                at = end

    return inner.mapInArrow(run, schema)
