"""Vectorised 64-bit hashing that gives the same values in every process."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words kept in a worker's cache before it is emptied; a bound on memory, without effect on results.
CACHE_WORDS = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class WordHashes(dict):
    """word -> 64-bit hash, computed on first use."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of ``width`` successive word hashes, and where each begins first."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(h, return_index=True)
