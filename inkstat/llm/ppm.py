"""Prediction by partial matching over bytes, with frozen statistics.

A text is its UTF-8 bytes (A-Z lower-cased) and then one end symbol.  A trie
keeps, for every context of up to `order` bytes, how often each byte followed.
A byte is coded in its longest known context; if the context does not know it,
an escape leads to the next shorter one.  Escapes are estimated as half the number
of distinct followers, taken evenly from their counts (method D), and what the longer context would have coded
is excluded from the shorter one's total.  Below order 0 all 256 byte values
that order 0 does not hold are alike; two of them, which UTF-8 never uses,
stand for the start padding and the end.

Every occurrence of a context's follower is one of its suffix's followers too,
so what exclusion takes from a context depends only on the longer context that
escaped to it.  Totals after exclusion are therefore kept with the longer
context, and scoring is a handful of vectorised look-ups per byte.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

START, END = 0xFE, 0xFF


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per predicted symbol its context of `order` bytes and itself as one integer (itself lowest); where each text begins."""
    lens = np.diff(offsets)
    n = len(lens)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buf = np.full(7 + len(data) + n * (order + 1), START, np.uint8)
    shift = 7 + order + np.arange(n) * (order + 1)
    buf[np.arange(len(data)) + np.repeat(shift, lens)] = data
    ends = shift + offsets[1:]
    buf[ends] = END
    keep = np.ones(len(buf) - 7, bool)
    keep[((shift + offsets[:-1] - order - 7)[:, None] + np.arange(order)).ravel()] = False
    mask = np.uint64((1 << 8 * (order + 1)) - 1)
    keys = np.ndarray(len(buf) - 7, ">u8", buf.data, 0, (1,))[keep].astype(np.uint64) & mask
    return keys, offsets[:-1] + np.arange(n)


class Model:
    """orders: for j = 0..order the sorted keys of (context of j bytes, symbol) and their counts, one column a model."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]], final: bool = True):
        self.order = len(orders) - 1
        self.keys = [k for k, _ in orders]
        self.log = [np.log(np.maximum(c - 0.5, 0.5)).astype(np.float32) for _, c in orders]
        self.known = [c > 0 for _, c in orders]
        self.contexts, self.fresh, self.escape, self.total, self.alive, self.low, self.low_escape = [], [], [], [], [], [], []
        totals = None
        for j, (keys, counts) in enumerate(orders):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            add = (lambda v: np.add.reduceat(v, first, axis=0)) if len(first) else (lambda v: np.zeros((0, v.shape[1])))  # noqa: B023
            total, distinct = add(counts.astype(float)), add((counts > 0).astype(float))
            self.contexts.append(context[first])
            self.alive.append(total > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.total.append(np.log(np.maximum(total, 1)).astype(np.float32))
                self.escape.append(np.where(total > 0, np.log(0.5 * distinct / total), 0).astype(np.float32))
                if j == 0:
                    self.low.append(np.zeros_like(total, np.float32))
                    left = np.maximum(256 - distinct, 1)
                    self.low_escape.append(-np.log(left).astype(np.float32))  # order -1
                else:
                    suffix = np.searchsorted(self.keys[j - 1], keys & np.uint64((1 << 8 * j) - 1))
                    excluded = add(orders[j - 1][1][suffix].astype(float) * (counts > 0))
                    under = np.searchsorted(self.contexts[j - 1], self.contexts[j] & np.uint64((1 << 8 * (j - 1)) - 1))
                    more = totals[1][under] - distinct
                    left = totals[0][under] - excluded
                    self.low.append(np.log(np.maximum(left, 1)).astype(np.float32))
                    self.low_escape.append(np.where((more > 0) & (left > 0), np.log(0.5 * more / left), 0).astype(np.float32))
            totals = (total, distinct)
        if final:  # for logs and text_logs
            self.final = self.chain(self.keys[self.order])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "indexes"}

    def find(self, kind: str, j: int, keys: np.ndarray) -> np.ndarray:
        indexes = self.__dict__.setdefault("indexes", {})
        if (kind, j) not in indexes:
            indexes[kind, j] = pd.Index((self.keys if kind == "keys" else self.contexts)[j])
        return indexes[kind, j].get_indexer(keys)

    def chain(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's probability in its context, one column a model."""
        n, models = len(keys), self.log[0].shape[1]
        so_far, out = np.zeros((n, models), np.float32), np.zeros((n, models), np.float32)
        came, done, above = np.zeros((n, models), bool), np.zeros((n, models), bool), None
        if not n or not len(self.keys[0]):
            return out - np.float32(np.log(256))
        for j in range(self.order, -1, -1):
            grams = keys & np.uint64((1 << 8 * (j + 1)) - 1)
            gram, here = self.find("keys", j, grams), self.find("contexts", j, grams >> np.uint64(8))
            there = (here >= 0)[:, None] & self.alive[j][here]
            if above is None:
                total, escape = self.total[j][here], self.escape[j][here]
            else:
                total = np.where(came, self.low[j + 1][above], self.total[j][here])
                escape = np.where(came, self.low_escape[j + 1][above], self.escape[j][here])
            hit = ~done & (gram >= 0)[:, None] & self.known[j][gram]
            out = np.where(hit, so_far + self.log[j][gram] - total, out)
            done |= hit
            so_far = np.where(there, so_far + escape, so_far)
            came, above = came | there, here
        return np.where(done, out, so_far + self.low_escape[0][0])

    def logs(self, keys: np.ndarray) -> np.ndarray:
        at = self.find("keys", self.order, keys)
        out = self.final[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = self.chain(new)[back]
        return out

    def text_logs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each text's probability under each model."""
        keys, first = gram_keys(data, offsets, self.order)
        if not len(first):
            return np.zeros((0, self.log[0].shape[1]))
        return np.add.reduceat(self.logs(keys).astype(np.float64), first, axis=0)


def suffix_orders(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal keys; keys come back sorted."""
    new, back = np.unique(keys, return_inverse=True)
    out = np.zeros((len(new), counts.shape[1]))
    np.add.at(out, back, counts)
    return new, out
