"""FM-index of integer sequences: suffix sorting, wavelet-tree ranks, sampled positions.

The indexed text is a list of segments of symbols 1, 2, ... Each segment ends with
a separator, symbol 0; separators sort before all symbols and among each other
by position, so no suffix comparison runs past its segment.
"""

from __future__ import annotations

import numpy as np


def ranks_of(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index at which each key's run begins."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over those not yet told apart."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    separator = text == 0
    cuts = int(separator.sum())
    # First ranks: separators are all different, in order of position.
    first = np.where(separator, np.cumsum(separator) - 1, text.astype(np.int64) + cuts)
    # As many symbols as fit in a key; nothing after a separator counts.
    width = max(1, 62 // max(1, int(cuts + symbols + 1).bit_length()))
    base = cuts + symbols + 1
    key, open_ = first.copy(), ~separator
    for k in range(1, width):
        ahead = np.zeros(n, np.int64)
        if k < n:
            ahead[: n - k] = first[k:]
        key = key * base + np.where(open_, ahead, 0)
        still = np.zeros(n, bool)
        if k < n:
            still[: n - k] = ~separator[k:]
        open_ &= still
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = ranks_of(key[order])
    depth = width
    # Runs of equal rank, which are whole stretches of the order, are sorted by what follows.
    lows = rank[order]
    tied = np.flatnonzero(np.r_[lows[1:] == lows[:-1], False] | np.r_[False, lows[1:] == lows[:-1]])
    while len(tied):
        at = order[tied]
        low = rank[at]
        after = at + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        sort = np.lexsort((follow, low))
        at, low, follow = at[sort], low[sort], follow[sort]
        order[tied] = at
        new = np.r_[True, (low[1:] != low[:-1]) | (follow[1:] != follow[:-1])]
        run = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[at] = run
        same = np.r_[run[1:] == run[:-1], False] | np.r_[False, run[1:] == run[:-1]]
        tied = tied[same]
        depth *= 2
    return order


class Bits:
    """A bit vector that counts its zeros before a position."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bool)], bitorder="little").view(np.uint64)
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletTree:
    """Ranks of symbols in a sequence, level by level (all nodes of a level in one bit vector)."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        now = sequence.astype(np.int64)
        for level in reversed(range(max(1, int(symbols).bit_length()))):
            bits = (now >> level) & 1 != 0
            self.levels.append((level, Bits(bits), len(now) - int(bits.sum())))
            now = np.concatenate([now[~bits], now[bits]])
        every = np.arange(symbols + 1)
        self.starts = self.down(every, np.zeros(symbols + 1, np.int64))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones_before(at)
            at = np.where((symbol >> level) & 1 != 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self.down(symbol, at) - self.starts[symbol]

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for level, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.ones_before(at)
            symbol |= one.astype(np.int64) << level
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.starts[symbol]


class FMIndex:
    """Backward search and location in segments of symbols from 1 to ``symbols``."""

    #: One of so many positions of a segment is kept, its first included.
    SAMPLED = 16

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        """``text`` ends with a separator, 0, unless it is empty."""
        order = suffix_array(text, symbols)
        before = np.where(order > 0, text[order - 1], 0) if len(text) else text
        self.tree = WaveletTree(before, symbols)
        self.begins = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols + 1))]
        separators = np.flatnonzero(text == 0)
        start = np.r_[0, separators[:-1] + 1] if len(separators) else separators
        lengths = np.diff(np.r_[start, len(text)])
        offset = np.arange(len(text)) - np.repeat(start, lengths)
        sampled = (offset % self.SAMPLED == 0)[order]
        self.marks = Bits(sampled)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, from low to high, of suffixes that begin with each phrase; phrases end at the last column."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        if not len(phrases):
            return low, high
        last = phrases[:, -1]
        low, high = self.begins[last], self.begins[last + 1]
        for back in range(2, phrases.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (high > low))
            if not len(on):
                break
            symbol = phrases[on, -back]
            low[on] = self.begins[symbol] + self.tree.rank(symbol, low[on])
            high[on] = self.begins[symbol] + self.tree.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of rows that begin with a symbol: walks back to a kept position."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        going = np.arange(len(rows))
        while len(going):
            kept = self.marks.get(at)
            out[going[kept]] = self.samples[self.marks.ones_before(at[kept])] + steps
            going, at = going[~kept], at[~kept]
            symbol, rank = self.tree.step(at)
            at = self.begins[symbol] + rank
            steps += 1
        return out
