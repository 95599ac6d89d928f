"""Hashes of words, word runs and sets, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1
#: Distinct words whose hashes a worker remembers at a time.
REMEMBERED = 500_000
#: Odd bases of the two polynomial hashes of word runs.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class WordHashes(dict):
    """A 64-bit hash of each word, remembered in bounded space."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if k <= 8:
        out = h[:n].copy()
        for j in range(1, k):
            out *= np.uint64(base)
            out += h[j : n + j]
        return mixed(out)
    inverse = pow(base, -1, 1 << 64)
    down = np.empty(len(h), dtype=np.uint64)
    down[0] = 1
    down[1:] = inverse
    np.multiply.accumulate(down, out=down)
    up = np.empty(n, dtype=np.uint64)
    up[0] = 1
    up[1:] = base
    np.multiply.accumulate(up, out=up)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * down, out=total[1:])
    return mixed((total[k:] - total[:-k]) * up)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, the whole sequence is one."""
    if not len(h):
        return h
    if len(h) < k:
        x = np.uint64(len(h))
        for v in h:
            x = mixed(np.array([x * np.uint64(BASE) + v], dtype=np.uint64))[0]
        return np.array([x], dtype=np.uint64)
    return np.unique(runs(h, k))
