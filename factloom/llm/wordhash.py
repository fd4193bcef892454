"""Words of UTF-8 text columns as 64-bit hashes, whole Arrow batches at a time.

Words are cut at single-byte separators, so bytes are enough and no Python string is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_OTHER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_M1, _M2 = U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F | 1)

#: Separators as a byte mask: white space only, and everything in ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _inverse(m: int) -> int:
    return pow(int(m), -1, 2**64)


#: Bytes of texts that are hashed together, and powers that are kept for them.
CHUNK_BYTES = 1 << 18
KEPT = CHUNK_BYTES + 8


class _Powers:
    """Powers of an odd multiplier and of its inverse; only the first ones are kept."""

    def __init__(self, m):
        self.m, self.inv, self.n = m, U(_inverse(m)), 0

    def get(self, n):
        if not self.n:
            self.up, self.down = self._make(KEPT)
            self.n = KEPT
        up, down = (self.up, self.down) if n <= KEPT else self._make(n)
        return up[:n], down[:n]

    def _make(self, n):
        out = []
        for base in (self.m, self.inv):
            p = np.full(n, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p, out=p))
        return out


_P1, _P2 = _Powers(_M1), _Powers(_M2)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """Yield (first, last, bytes, offsets) over runs of rows of about ``size`` bytes; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Word starts, ends and rows of one chunk."""

    def __init__(self, data, offsets, separators, lower=False):
        data = LOWER[data] if lower else data  # before cutting: capitals may count as separators
        self.data, self.offsets = data, offsets
        sep = np.ones(len(data) + 2, bool)
        sep[1:-1] = separators[data]
        edge = sep[1:] != sep[:-1]
        inner = offsets[1:-1]
        joined = inner[(inner > 0) & (inner < len(data))]
        joined = np.unique(joined[~sep[joined] & ~sep[joined + 1]])  # a row ends within a run of word bytes
        starts, ends = np.flatnonzero(edge & ~sep[1:]), np.flatnonzero(edge & sep[1:])
        if len(joined):
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
        self.starts, self.ends = starts, ends
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self, other: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``other`` gives a second one that is independent of it."""
        data = self.data
        up, down = _P1.get(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        own = (_OTHER if other else _BYTE)[data]
        own *= up[:-1]
        np.cumsum(own, out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(U) * U(0x2545F4914F6CDD1D))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes; rows are not told apart here."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = _P2.get(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n] + U(k))


def unique_pairs(a: np.ndarray, b: np.ndarray):
    """Distinct pairs in order, which of them each pair is, and how often each is there."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[new], y[new], which, np.bincount(which, minlength=int(new.sum()))


def starts_inside(first: np.ndarray, k: int) -> np.ndarray:
    """Positions at which ``k`` words of one row begin, given each row's first word and the total as last entry."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    size = np.diff(first)
    rows = size >= k
    np.add.at(ok, first[:-1][rows], 1)
    np.add.at(ok, first[1:][rows] - k + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def spread(starts: np.ndarray, length, total: int) -> np.ndarray:
    """Mask of the positions that lie in any [start, start + length)."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d[:-1]) > 0
