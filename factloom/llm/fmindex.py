"""Full-text index over one shard's word symbols: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of integer symbols by prefix doubling; the end sorts first.  Only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    value = s[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] != value[:-1]])[:n], np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    k = 1
    while True:
        same = np.concatenate([[False], head[1:] == head[:-1], [False]])
        tied = np.flatnonzero(same[1:] | same[:-1])[: n]
        if not len(tied):
            return order
        own = order[tied]
        after = np.where(own + k < n, rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        head[tied] = tied[np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))]
        rank[own] = head[tied]
        k *= 2


class _Bits:
    """Bit vector with rank: whole words counted ahead, one popcount per query."""

    def __init__(self, bits):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def rank(self, i):
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1))).astype(np.int64)

    def at(self, i):
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class FMIndex:
    """Index of symbols 1..``size``-1; 1 stands between texts, and no phrase holds it.  Symbol 0 ends the whole and is put there by this class."""

    def __init__(self, symbols: np.ndarray, size: int):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        between = text == 1
        # each boundary sorts as a symbol of its own, so copies of a text are told apart at their ends
        sa = suffix_array(np.where(text > 1, text + between.sum(), np.where(between, np.cumsum(between), 0)))
        bwt = text[sa - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.zeros = [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            b = (cur >> level) & 1
            self.bits.append(_Bits(b))
            self.zeros.append(int((b == 0).sum()))
            cur = np.concatenate([cur[b == 0], cur[b == 1]])
        marked = (sa % SAMPLE == 0) | (text[sa - 1] == 1)  # the way back never crosses a boundary
        self.marked, self.samples = _Bits(marked), sa[marked]

    def _rank(self, symbol, i):
        """Occurrences of ``symbol`` among the first ``i`` of the transform."""
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1) == 1
            a, b = self.bits[k].rank(lo), self.bits[k].rank(hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def _back(self, i):
        """Row of the suffix that starts one symbol earlier."""
        at, symbol = i, np.zeros_like(i)
        lo = np.zeros_like(i)
        for k in range(self.levels):
            bit = self.bits[k].at(at)
            one = bit == 1
            a, p = self.bits[k].rank(lo), self.bits[k].rank(at)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            at = np.where(one, self.zeros[k] + p, at - p)
            symbol = symbol * 2 + bit
        return self.before[symbol] + at - lo

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray):
        """Suffix rows [lo, hi) of each phrase, all searched backwards together."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            on = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(on):
                break
            c = phrases[on, lengths[on] - 1 - step]
            lo[on] = self.before[c] + self._rank(c, lo[on])
            hi[on] = self.before[c] + self._rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marked.at(rows[open_]) == 1
            done = open_[hit]
            out[done] = self.samples[self.marked.rank(rows[done])] + steps[done]
            open_ = open_[~hit]
            rows[open_] = self._back(rows[open_])
            steps[open_] += 1
        return out
