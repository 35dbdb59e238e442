"""An FM-index over a sequence of integers, searched and located for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 counts as a symbol of its own, below all others and rising with its place."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + ends.sum())
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        at = key[order]
        new = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """The levels of a wavelet tree side by side; rank counts a symbol before a place."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for k in reversed(range(bits)):
            ones = (values >> k & 1).astype(bool)
            packed = np.packbits(np.pad(ones, (0, -len(ones) % 64 + 64)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.levels.append((packed, before, len(ones) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.zeros_like(at)
        for k, level in zip(reversed(range(self.bits)), self.levels):
            one = (symbols >> k & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, at)
            low, at = np.where(one, level[2] + a, low - a), np.where(one, level[2] + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in self.levels:
            one = (level[0][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, level[2] + ones, at - ones)
            out = out << 1 | one
        return out


class FmIndex:
    """text: integers from 1 on; 0 begins it and parts runs that no pattern may span.

    Every `sample`-th place, and every run's first, is kept.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        if not len(text) or text[0]:
            raise ValueError("a text begins with 0")
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletMatrix(last, max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.kept = (order % sample == 0) | (last == 0)
        self.kept_before = np.cumsum(self.kept) - self.kept
        self.places = order[self.kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of patterns end in the last column and may begin with -1s; returns each one's suffix range."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.kept), np.int64)
        for k in reversed(range(patterns.shape[1])):
            go = np.flatnonzero((patterns[:, k] >= 0) & (low < high))
            s = patterns[go, k]
            low[go], high[go] = self.before[s] + self.tree.rank(s, low[go]), self.before[s] + self.tree.rank(s, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back until a kept one."""
        out, at, back = np.zeros(len(rows), np.int64), rows.astype(np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            there = self.kept[at]
            out[open_[there]] = self.places[self.kept_before[at[there]]] + back
            open_, at = open_[~there], at[~there]
            s = self.tree.access(at)
            at = self.before[s] + self.tree.rank(s, at)
            back += 1
        return out
