"""SHA-256 over whole arrays of messages, with the state kept between blocks.

The library's hash objects can be copied but not stored; here a state is eight numbers, so a table can hold it.  Only
messages of whole 64-byte blocks are needed: a digest in hex is one block.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= x else (low, mid - 1)
    return low


#: First 32 bits of the fractions of cube roots of 64 primes and of square roots of 8.
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x, by: int):
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one block (16, n) each."""
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for k, x in zip(ROUND, w, strict=True):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + k + x
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Blocks (16, n) of the hex texts of digests (n, 32)."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[digests >> 4], HEX[digests & 15]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).T)


def fresh(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of messages that have had so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 1 << 31, blocks.astype(np.uint32) * np.uint32(512)
    return to_bytes(compress(state, last))


def to_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def from_bytes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(data).view(">u4").astype(np.uint32).T)
