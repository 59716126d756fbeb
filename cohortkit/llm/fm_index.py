"""An FM-index over integer tokens in numpy, for matching statistics of many texts at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over a sequence of small integers: one bit vector a binary digit."""

    def __init__(self, x: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(x)
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros((n >> 6) + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.words.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]].astype(np.int64))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` ends when the levels send it the way of ``symbol``."""
        for level, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            at = i >> 6
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            up = (symbol >> (self.levels - 1 - level)) & 1
            i = np.where(up == 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Backward search over the suffixes of ``tokens``, told apart by their first ``2 * cap`` tokens at most.

    ``tokens`` are 0..symbols-1; 0 separates texts and never matches.  Suffixes are
    sorted by prefix doubling; the BWT is kept as a wavelet matrix; common prefixes
    of neighbours (to ``cap``) let a match give up its last tokens.
    """

    def __init__(self, tokens: np.ndarray, symbols: int, cap: int):
        n = len(tokens)
        self.cap = cap
        ranks = [(1, self._dense(tokens.astype(np.int64)))]
        order, depth = None, 1
        while depth < cap or order is None:
            r = ranks[-1][1]
            behind = np.zeros(n, np.int64)
            behind[:max(0, n - depth)] = r[depth:] + 1
            pair = r * (n + 1) + behind
            order = np.argsort(pair, kind="stable")
            depth *= 2
            ranks.append((depth, self._ranked(pair, order)))
        self.order = order
        common = np.zeros(n, np.int64)
        a, b = order[:-1], order[1:]
        for d, r in reversed(ranks[:-1]):
            r = np.append(r, -1)                     # positions past the end match nothing
            x, y = np.minimum(a + common[1:], n), np.minimum(b + common[1:], n)
            common[1:] += np.where((r[x] == r[y]) & (x < n) & (y < n), d, 0)
        self.common = np.append(np.minimum(common, cap), 0)      # common[i]: of suffixes i-1 and i
        self.common[0] = 0
        bwt = tokens[order - 1]
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), symbols)
        first = np.r_[0, np.cumsum(np.bincount(tokens, minlength=symbols))[:-1]]
        self.shift = first - self.wavelet.place(np.arange(symbols), np.zeros(symbols, np.int64))
        self.edges: dict[int, np.ndarray] = {}

    @staticmethod
    def _dense(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1].astype(np.int64)

    @staticmethod
    def _ranked(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        s = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        return rank

    def widen(self, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first ``length`` tokens of the suffixes at ``lo``."""
        if length <= 0:
            return np.zeros_like(lo), np.full_like(lo, len(self.order))
        if length not in self.edges:
            self.edges[length] = np.append(np.flatnonzero(self.common[:-1] < length), len(self.order))
        at = np.searchsorted(self.edges[length], lo, "right")
        return self.edges[length][at - 1], self.edges[length][at]

    def extend(self, symbol, lo, hi):
        lo, hi = self.wavelet.place(symbol, lo), self.wavelet.place(symbol, hi)
        return lo + self.shift[symbol], hi + self.shift[symbol]

    def matching_statistics(self, queries: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Per query token: the length (to ``cap``) of the longest match that begins there, and
        the suffix interval of that match.  All queries go back one token at a time together."""
        n = len(self.order)
        length = np.zeros(len(queries), np.int64)
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), n)
        lo, hi, m = np.zeros(len(starts), np.int64), np.full(len(starts), n), np.zeros(len(starts), np.int64)
        at = ends - 1
        live = np.flatnonzero(at >= starts)
        while len(live):
            c = queries[at[live]]
            # a match of full length first gives up its last token
            full = live[m[live] == self.cap]
            if len(full):
                lo[full], hi[full] = self.widen(lo[full], self.cap - 1)
                m[full] = self.cap - 1
            new_lo, new_hi = self.extend(c, lo[live], hi[live])
            bad = (new_lo >= new_hi) & (m[live] > 0)
            while bad.any():
                # on to the parent interval: the longest shorter prefix with more suffixes
                own = live[bad]
                parent = np.maximum(self.common[lo[own]], self.common[hi[own]])
                for d in np.unique(parent):
                    part = own[parent == d]
                    lo[part], hi[part] = self.widen(lo[part], int(d))
                    m[part] = d
                new_lo[bad], new_hi[bad] = self.extend(c[bad], lo[own], hi[own])
                bad = (new_lo >= new_hi) & (m[live] > 0)
            hit = (new_lo < new_hi) & (c > 0)
            lo[live], hi[live] = np.where(hit, new_lo, 0), np.where(hit, new_hi, n)
            m[live] = np.where(hit, m[live] + 1, 0)
            length[at[live]], low[at[live]], high[at[live]] = m[live], lo[live], hi[live]
            at[live] -= 1
            live = live[at[live] >= starts[live]]
        return length, low, high
