"""A word-level FM-index of one training shard, in numpy.

The text is a sequence of symbols (1 and up) in runs that are divided by a
separator (0). Suffixes are sorted by prefix doubling; separators count as
different from each other, so no comparison goes beyond a run. The BWT is held
as a wavelet matrix; all phrases are searched backward at once, and occurrences
are located by walking back to a sampled suffix position.
"""

from __future__ import annotations

import numpy as np

#: Every so many text positions a suffix position is kept; the first of each run is kept too.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling in which each round sorts only what is still tied; a rank is the place of the first suffix of its tie."""
    n, zeros = len(text), np.flatnonzero(text == 0)
    symbol = text.astype(np.int64) + len(zeros)
    symbol[zeros] = np.arange(len(zeros))
    order = np.argsort(symbol, kind="stable")
    key, slots, rank, step = symbol[order], np.arange(n), np.empty(n, np.int64), 1
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.concatenate((new[1:], [True])))]
        if not len(slots):
            return order
        tied = order[slots]
        # tied suffixes share ``step`` symbols, none of which is a separator, so they don't end here
        key = rank[tied] * n + rank[tied + step]
        by = np.argsort(key)
        order[slots], key, step = tied[by], key[by], 2 * step


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for level in reversed(range(bits)):
            one = (values >> level & 1).astype(bool)
            ones = np.concatenate(([0], np.cumsum(one, dtype=np.int32)))
            self.levels.append((level, ones, len(values) - int(ones[-1])))
            values = np.concatenate((values[~one], values[one]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        lo, hi = np.zeros_like(end), end
        for level, ones, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol, lo, hi = np.zeros_like(at), np.zeros_like(at), at
        for level, ones, zeros in self.levels:
            a, b = ones[lo], ones[hi]
            one = ones[hi + 1] > b
            symbol = symbol | one.astype(at.dtype) << level
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return symbol, hi - lo


class FmIndex:
    def __init__(self, text: np.ndarray):
        """text: runs of symbols, each run followed by one 0."""
        order = suffix_array(text)
        bwt = text[order - 1].astype(np.int64)
        self.size, bits = len(text), max(1, int(text.max(initial=0)).bit_length())
        self.tree = WaveletMatrix(bwt, bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        self.symbols = 1 << bits
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; phrases: right-aligned symbols, 0 on the left of short ones."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > k) & (hi > lo))
            if not len(live):
                break
            c = phrases[live, -1 - k].astype(np.int64)
            hi[live[c >= self.symbols]] = lo[live[c >= self.symbols]]  # a symbol that this shard lacks
            live, c = live[c < self.symbols], c[c < self.symbols]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            at = rows[todo]
            done = self.kept[at + 1] > self.kept[at]
            out[todo[done]] = self.positions[self.kept[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            symbol, count = self.tree.access(at)
            rows[todo] = self.before[symbol] + count
            steps += 1
        return out
