"""Vectorised hashes over the words of a text."""

from __future__ import annotations

import numpy as np
import xxhash

from . import memory

_A, _B, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered by each worker; a full table becomes the old one, which is asked first.
    Long words are not remembered, so the table is bounded in bytes."""

    most, longest, old = 200_000, 64, {}

    def __missing__(self, word: bytes) -> int:
        if len(word) > self.longest:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        memory.holds(self.forget)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


class Spans:
    """Hashes of any span of words in constant time, by running sums of word hashes times powers of an odd base."""

    _base = 0xD1342543DE82EF95
    _powers = _inverse = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        need = len(hashes) + 1
        if len(Spans._powers) < need:
            size = max(need, 2 * len(Spans._powers), 4096)
            inverse = pow(self._base, -1, 1 << 64)
            for name, base in (("_powers", self._base), ("_inverse", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(Spans, name, np.cumprod(steps))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * Spans._powers[: len(hashes)])])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Spans._inverse[start] + (end - start).astype(np.uint64) * _GOLD)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
