"""Word shingles as 64-bit hashes, for the Python workers of near-duplicate operators."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_MOST_WORDS = 400_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def words(text: str | None) -> list[str]:
    """Lower-cased words between white space; none for a null text."""
    return (text or "").lower().split()


def text_key(ws: list[str]) -> bytes:
    """What texts of the same words have in common."""
    return hashlib.blake2b(" ".join(ws).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def hashed(ws: list[str]) -> np.ndarray:
    if len(_HASHES) > _MOST_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


def shingled(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, in order of their hash, and how often each occurs; a text of fewer than WIDTH words is one shingle."""
    h = hashed(ws)
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = min(WIDTH, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _MULTIPLIERS[i]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s, return_counts=True)
