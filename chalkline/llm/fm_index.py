"""A compressed FM-index over sequences of numbers: Burrows-Wheeler transform in a wavelet matrix, with the parent
operation on intervals, so that matching statistics come from backward search alone. Works on many queries at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank of a symbol before a position, in one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            b = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(b, bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(b) - b.sum()))
            symbols = np.concatenate([symbols[~b], symbols[b]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][w] + np.bitwise_count(self.bits[level][w] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[q] occurs before position i[q]."""
        start = np.zeros_like(i)
        for level in range(self.levels):
            one = ((c >> (self.levels - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, i)
            start = np.where(one, self.zeros[level] + a, start - a)
            i = np.where(one, self.zeros[level] + b, i - b)
        return i - start


class FMIndex:
    """Index of sequences; `owner` gives each sequence a number, and intervals know the least owner in them.

    Symbols are the ranks of the distinct numbers, from 1; 0 closes every sequence. Nothing matches across sequences.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, threshold: int):
        self.threshold = threshold
        self.alphabet, ranks = np.unique(flat, return_inverse=True)
        n, m = len(flat) + len(sizes), len(sizes)
        ends = np.cumsum(sizes) + np.arange(m)
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = ranks.reshape(-1) + 1
        # Closing symbols differ while sorting, so that all suffixes differ.
        rank = np.where(inner, text + m, 0)
        rank[ends] = np.arange(m)
        longest = int(sizes.max(initial=0)) + 1
        halves, h = [np.unique(rank, return_inverse=True)[1].reshape(-1).astype(np.int32)], 1
        while h < longest:
            nxt = np.zeros(n, np.int64)
            nxt[: n - h] = halves[-1][h:] + 1
            halves.append(np.unique(halves[-1].astype(np.int64) * (n + 1) + nxt, return_inverse=True)[1].reshape(-1).astype(np.int32))
            h *= 2
        order = np.argsort(halves[-1], kind="stable")
        # Longest common prefix of neighbours, from the ranks of halved lengths.
        at, before, lcp = order[1:].copy(), order[:-1].copy(), np.zeros(n, np.int64)
        for k in range(len(halves) - 1, -1, -1):
            ok = (np.maximum(at, before) < n)
            same = np.zeros(n - 1, bool)
            same[ok] = halves[k][at[ok]] == halves[k][before[ok]]
            step = np.where(same, 1 << k, 0)
            lcp[1:] += step
            at, before = at + step, before + step
        del halves, rank, at, before
        bwt = text[order - 1]
        bwt[order == 0] = 0
        self.n = n
        self.tree = WaveletMatrix(bwt, len(self.alphabet))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        # lcp[i] belongs to the border before row i; both outer borders are 0. Least values over 2**k borders.
        self.lcp = np.minimum(np.append(lcp, 0), threshold).astype(np.uint16)
        self.least = [self.lcp]
        while 1 << len(self.least) <= len(self.lcp):
            k = len(self.least) - 1
            self.least.append(np.minimum(self.least[k][: -(1 << k)], self.least[k][1 << k :]))
        seq = np.cumsum(~inner) - ~inner
        self.least_owner = np.asarray(owner)[seq[order]]
        new = self.lcp[:-1] < threshold
        start = np.flatnonzero(new)
        self.block = np.cumsum(new) - 1
        self.block_owner = np.minimum.reduceat(self.least_owner, start)

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        """Ranks of numbers, 0 for those that the index doesn't have."""
        at = np.minimum(np.searchsorted(self.alphabet, flat), max(0, len(self.alphabet) - 1))
        return np.where(self.alphabet[at] == flat, at + 1, 0) if len(self.alphabet) else np.zeros(len(flat), np.int64)

    def _widen(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share the first `depth` symbols with the rows lo..hi-1."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.least) - 1, -1, -1):
            back = lo - (1 << k) + 1
            ok = (back >= 0) & (self.least[k][np.maximum(back, 0)] >= depth)
            lo = np.where(ok, lo - (1 << k), lo)
            ok = (hi + (1 << k) <= self.n + 1) & (self.least[k][np.minimum(hi, len(self.least[k]) - 1)] >= depth)
            hi = np.where(ok, hi + (1 << k), hi)
        return lo, hi

    def statistics(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the queries: (length of the longest match that starts there, up to the threshold;
        least owner among the places of a match of full threshold length, -1 where there is none)."""
        symbols = self.symbols(flat)
        ends, q = np.cumsum(sizes), len(sizes)
        length, owner = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        lo, hi, depth = np.zeros(q, np.int64), np.full(q, self.n, np.int64), np.zeros(q, np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= step)
            pos = ends[live] - step
            c, todo = symbols[pos], np.arange(len(live))
            known = c > 0
            lo[live[~known]], hi[live[~known]], depth[live[~known]] = 0, self.n, 0
            todo = todo[known]
            # No more than threshold - 1 symbols are kept before each step, so that a window's own interval appears.
            full = live[todo][depth[live[todo]] >= self.threshold]
            if len(full):
                lo[full], hi[full] = self._widen(lo[full], hi[full], np.full(len(full), self.threshold - 1))
                depth[full] = self.threshold - 1
            while len(todo):
                i, cc = live[todo], c[todo]
                both = self.tree.rank(np.concatenate([cc, cc]), np.concatenate([lo[i], hi[i]]))
                a, b = self.first[cc] + both[: len(i)], self.first[cc] + both[len(i) :]
                hit = b > a
                lo[i[hit]], hi[i[hit]] = a[hit], b[hit]
                depth[i[hit]] += 1
                todo = todo[~hit]
                i = live[todo]
                if len(i):  # shorten the match to the parent interval and try again
                    up = np.maximum(self.lcp[lo[i]], self.lcp[hi[i]]).astype(np.int64)
                    up = np.minimum(up, depth[i] - 1)
                    lo[i], hi[i] = self._widen(lo[i], hi[i], np.maximum(up, 1))
                    root = up <= 0
                    lo[i[root]], hi[i[root]] = 0, self.n
                    depth[i] = np.maximum(up, 0)
            length[pos] = depth[live]
            whole = depth[live] >= self.threshold
            owner[pos[whole]] = self.block_owner[self.block[lo[live[whole]]]]
        return length, owner
