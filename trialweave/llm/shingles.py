"""Shingle sets of texts and their HyperMinHash registers."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Registers of a set, registers of a band (their 16-bit values fill a band's 64-bit key) and mantissa bits of a register.
REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
#: Sets of at most PERMUTED shingles get one hash function a register, sets of at least BUCKETED one hash dealt to buckets.
#: Between the two they get both, so any two sets with a Jaccard similarity of 0.8 share a kind.
PERMUTED, BUCKETED = 512, 409
EMPTY = 0xFFFF
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CACHED_WORDS = 1 << 17
_FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of `size`-word shingles as sorted 64-bit hashes; words are runs of other characters than [\\x20\\x09-\\x0D], A-Z in lower case."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def _word(self, word: bytes) -> int:
        if len(self.words) >= _CACHED_WORDS:
            self.words.clear()
        found = self.words[word] = xxhash.xxh64_intdigest(word)
        return found

    def set_of(self, text: str | None) -> np.ndarray:
        """Fewer words than a shingle's are one shingle together; no words, no shingles."""
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        get, new = self.words.get, self._word
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit values."""
    m, e = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - e, 62).astype(np.uint64)
    return zeros << np.uint64(MANTISSA) | np.minimum((m * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.uint64)


def _bands(registers: np.ndarray) -> list[int]:
    r = registers.reshape(BANDS, BAND)
    return (r[:, 0] << np.uint64(48) | r[:, 1] << np.uint64(32) | r[:, 2] << np.uint64(16) | r[:, 3]).astype(np.int64).tolist()


def permuted_bands(s: np.ndarray) -> list[int] | None:
    """Band keys of the least value of each of REGISTERS hash functions; None for large sets and the empty one."""
    return _bands(_registers((s[:, None] * _FACTORS).min(0))) if 0 < len(s) <= PERMUTED else None


def bucketed_bands(s: np.ndarray) -> list[int] | None:
    """Band keys of the least value in each of REGISTERS buckets of one hash; None for small sets. An empty bucket has a value of its own."""
    if len(s) < BUCKETED:
        return None
    at = np.searchsorted(s, _EDGES)
    first = s[np.minimum(at, len(s) - 1)]
    filled = (at < len(s)) & (first >> np.uint64(57) == _EDGES >> np.uint64(57))
    return _bands(np.where(filled, _registers(first << np.uint64(7)), np.uint64(EMPTY)))
