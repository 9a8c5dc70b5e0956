"""Words of many texts as flat arrays of 64-bit hashes, and hashes of word windows."""

from __future__ import annotations

import numpy as np
import xxhash


_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for words seen; emptied when it holds too many."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; ``lower`` changes A-Z only. A null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def windows(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """A hash of each ``size`` hashes in a row: a sum of products with odd numbers, mixed. Two independent families."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = hashes if family == 0 else mix(hashes)
    total = base[:n] * _ODD[family, 0]
    for k in range(1, size):
        total += base[k : k + n] * _ODD[family, k]
    return mix(total)


class Flat:
    """Words of documents in one array: ``doc`` and ``at`` give each word's document and place in it."""

    def __init__(self, words: list[list[bytes]], hashes: WordHashes):
        self.n = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.hashes = hashes.of([x for w in words for x in w])
        self.doc = np.repeat(np.arange(len(words)), self.n)
        self.at = np.arange(len(self.hashes)) - self.start[self.doc]

    def window_places(self, size: int) -> np.ndarray:
        """Where windows of ``size`` words of one document start."""
        return np.flatnonzero(self.at + size <= self.n[self.doc])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
