"""A compressed full-text index over word codes, with matching statistics.

The text is a set of word rows, each closed by a separator of its own.  Its suffix array gives
the Burrows-Wheeler transform, which a wavelet tree holds as one packed bit row a level with
rank counts.  Backward search extends a match by one word to its left with two rank
queries a level.  The array of longest common prefixes gives an interval's parent, the step that
drops words on a match's right.  All steps run for many query rows at a time.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence; level by level, each stably split by one bit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n = len(symbols)
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.bits, self.counts = [], [], []
        now = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(n_symbols)
        self.start = self._down(every, np.zeros(n_symbols, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a position."""
        return self._down(symbol, at) - self.start[symbol]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position of the first level lies in the last one, on the path of a symbol."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(i, at)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def _ones(self, i: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.bits[i][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.counts[i][word] + np.bitwise_count(below).astype(np.int64)


class RangeMin:
    """Least value of any range, from a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while (step := 1 << (len(self.rows) - 1)) * 2 <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-step], self.rows[-1][step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the range from lo to before hi, which must not be empty."""
        out = np.empty(len(lo), self.rows[0].dtype)
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for p in np.unique(power):
            at = np.flatnonzero(power == p)
            row = self.rows[p]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(p))])
        return out

    def left_below(self, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The nearest index up to ``at`` with a value below ``limit``; index 0 always counts as one."""
        at = at.copy()
        for p in range(len(self.rows) - 1, -1, -1):
            step = 1 << p
            lo = at - step + 1
            fits = lo >= 0
            fits[fits] = self.rows[p][lo[fits]] >= limit[fits]
            at = np.where(fits, at - step, at)
        return np.maximum(at, 0)

    def right_below(self, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The nearest index from ``at`` on with a value below ``limit``, or the length."""
        at, n = at.copy(), len(self.rows[0])
        for p in range(len(self.rows) - 1, -1, -1):
            step = 1 << p
            fits = at + step <= n
            fits[fits] = self.rows[p][at[fits]] >= limit[fits]
            at = np.where(fits, at + step, at)
        return at


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array by prefix doubling, and the ranks of all prefixes of 1, 2, 4, ... words."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    ranks = [rank]
    while True:
        following = np.zeros(n, np.int64)
        following[:-step] = rank[step:] + 1
        pair = rank * (n + 2) + following
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        ordered = pair[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[order[-1]] == n - 1:
            return order, ranks
        rank = new
        ranks.append(rank)
        step *= 2
        if step >= n:
            return order, ranks


class FMIndex:
    """Word rows of documents, indexed; ``docs`` has a row's document."""

    def __init__(self, rows: list[np.ndarray], docs: np.ndarray):
        lengths = np.array([len(r) for r in rows], np.int64)
        m, n = len(rows), int(lengths.sum()) + len(rows)
        self.words, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        text = np.empty(n, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        row_of = np.repeat(np.arange(m), lengths + 1)
        closing = starts[1:] - 1
        plain = np.ones(n, bool)
        plain[closing] = False
        text[plain] = inverse + m
        text[closing] = np.arange(m)
        self.docs = np.unique(docs)
        own = np.searchsorted(self.docs, docs).astype(np.int32)[row_of]
        order, ranks = suffix_order(text)
        self.n, self.m = n, m
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, m + len(self.words))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=m + len(self.words)))])
        self.least = RangeMin(own[order])
        shared = np.zeros(n, np.int64)  # of each suffix with the one before it in order
        a, b = order[:-1].copy(), order[1:].copy()
        for p in range(len(ranks) - 1, -1, -1):
            step = 1 << p
            fits = np.maximum(a, b) + step <= n
            same = fits.copy()
            same[fits] = ranks[p][a[fits]] == ranks[p][b[fits]]
            a, b = a + step * same, b + step * same
            shared[1:] += step * same
        self.shared = shared
        self.lcp = RangeMin(shared.astype(np.int32))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word codes; -1 for a word that the index lacks."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + self.m, -1)

    def matching_statistics(self, queries: list[np.ndarray], below: np.ndarray) -> list[np.ndarray]:
        """For each position of each query, the longest match from there on in a document below the query's bound."""
        below = np.searchsorted(self.docs, below)
        lengths = np.array([len(q) for q in queries], np.int64)
        width = int(lengths.max())
        codes = np.full((len(queries), width), -1, np.int64)
        for i, q in enumerate(queries):
            codes[i, : len(q)] = self.symbols(q)
        out = np.zeros((len(queries), width), np.int64)
        at = lengths - 1
        lo, hi, depth = np.zeros(len(queries), np.int64), np.full(len(queries), self.n), np.zeros(len(queries), np.int64)
        active = np.flatnonzero(at >= 0)
        while len(active):
            l, h, d, c = lo[active], hi[active], depth[active], codes[active, at[active]]
            known = c >= 0
            symbol = np.where(known, c, 0)
            ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([l, h]))
            new_l = self.before[symbol] + ranks[: len(active)]
            new_h = self.before[symbol] + ranks[len(active) :]
            good = known & (new_l < new_h)
            good[good] = self.least.of(new_l[good], new_h[good]) < below[active[good]]
            done = active[good]
            lo[done], hi[done], depth[done] = new_l[good], new_h[good], d[good] + 1
            out[done, at[done]] = depth[done]
            at[done] -= 1
            # no longer match: a word less on the right, or none at all
            bad = ~good
            lost = active[bad & ((d == 0) | ~known)]
            lo[lost], hi[lost], depth[lost] = 0, self.n, 0
            at[lost] -= 1
            up = bad & (d > 0) & known
            if up.any():
                rest, pl, ph = active[up], l[up], h[up]
                right = np.where(ph < self.n, self.shared[np.minimum(ph, self.n - 1)], 0)
                parent = np.maximum(self.shared[pl], right)
                lo[rest] = self.lcp.left_below(pl, parent)
                hi[rest] = self.lcp.right_below(ph, parent)
                depth[rest] = parent
            active = np.flatnonzero(at >= 0)
        return [out[i, : len(q)] for i, q in enumerate(queries)]
