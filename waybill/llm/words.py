"""Words of many texts as arrays: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20  # bytes hashed at a time
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambled 64-bit value for each 64-bit value, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(BASE)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a blank behind each text, and where each text ends."""
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return np.frombuffer(b" ".join(texts) + b" " if texts else b"", np.uint8), ends


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    edge = np.flatnonzero(np.diff(np.r_[True, BLANKS[data], True].astype(np.int8)))
    return edge[0::2], edge[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: the polynomial of its bytes modulo 2^64, from running sums, scrambled."""
    out = np.empty(len(start), np.uint64)
    first = 0
    size = min(len(data), max(BLOCK, int((end - start).max(initial=0))))
    power, inverse = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    while first < len(start):
        a = start[first]
        last = max(first + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        part = data[a : end[last - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= power[: len(part)]
        sums = np.r_[np.uint64(0), np.cumsum(part)]
        s, e = start[first:last] - a, end[first:last] - a
        out[first:last] = mixed((sums[e] - sums[s]) * inverse[s])
        first = last
    return out
