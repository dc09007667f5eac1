"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """A bounded memo of 64-bit word hashes; beyond ``limit`` words it only computes."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words, in order; of the whole where it has fewer words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * MULTIPLIER + hashes[k : n - size + 1 + k]
    return mixed(total + np.uint64(size))


def shingle_set(text: str | None, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased word shingles; empty for a text without words."""
    return np.unique(windows(memo.of((text or "").lower().split()), size))
