"""A word-level FM-index: suffix array by prefix doubling, wavelet matrix, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order. Three symbols are sorted at once, then the depth doubles;
    after the first rounds only suffixes that are still tied are sorted again."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(3, np.int64)])
    bits = max(1, int(padded.max()).bit_length())
    depth = 3 if 3 * bits <= 62 else 2 if 2 * bits <= 62 else 1
    key = padded[:n].copy()
    for i in range(1, depth):
        key = (key << bits) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    starts = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    while True:
        tied = np.zeros(n, bool)
        same = head[1:] == head[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffixes = order[at]
        second = rank[np.minimum(suffixes + depth, n)] + 1
        by = np.argsort(head[at] * (n + 2) + second, kind="stable")
        suffixes, first, second = suffixes[by], head[at][by], second[by]
        order[at] = suffixes
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[suffixes] = head[at]
        depth *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many (symbol, position) pairs at once."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(max(1, sigma - 1)).bit_length())
        self.zeros: list[np.ndarray] = []
        current = values.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            before = np.zeros(len(current) + 1, np.int32)
            np.cumsum(1 - bit, out=before[1:])
            self.zeros.append(before)
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for before in self.zeros:
            z = before[at]
            one = before[at + 1] == z
            symbol = (symbol << 1) | one
            at = np.where(one, before[-1] + at - z, z)
        return symbol

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start = np.zeros(len(symbol), np.int64)
        end = end.astype(np.int64)
        for level, before in zip(range(self.levels - 1, -1, -1), self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            z = int(before[-1])
            zs, ze = before[start], before[end]
            start, end = np.where(one, z + start - zs, zs), np.where(one, z + end - ze, ze)
        return end - start


class FMIndex:
    """Counts and locates phrases in a sequence of symbols 1..sigma-1; 0 separates documents."""

    def __init__(self, symbols: np.ndarray, sigma: int, step: int = 16):
        self.n, self.step = len(symbols), step
        order = suffix_array(symbols)
        self.last = WaveletMatrix(symbols[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # The row of the whole text and the rows whose predecessor is a separator aren't walked over:
        # within a document, a position that is a multiple of ``step`` or the first of the document is sampled.
        sampled = (order % step == 0) | (symbols[order - 1] == 0)
        self.before = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases, one per row of ``phrases``, by searching backwards."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            a = self.first[symbol] + self.last.rank(symbol, low[alive])
            b = self.first[symbol] + self.last.rank(symbol, high[alive])
            low[alive], high[alive] = a, b
            alive = alive[b > a]
            if not len(alive):
                break
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a sampled row."""
        rows, walked = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            hit = self.before[here + 1] > self.before[here]
            out[left[hit]] = self.samples[self.before[here[hit]]] + walked[left[hit]]
            left, here = left[~hit], here[~hit]
            symbol = self.last.access(here)
            rows[left] = self.first[symbol] + self.last.rank(symbol, here)
            walked[left] += 1
        return out
