"""Sets of word shingles as sorted 64-bit hashes, made in Python tasks batch by batch."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _SPREAD
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case (bytes know no other case)."""
    return text.lower().split() if text else []


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` neighbouring words, in order."""
    n = len(hashes) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = mixed(total * _STEP + hashes[k : k + n])
    return total


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words, but not none, is one shingle."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    sorted_ = np.sort(windows(word_hashes(found), min(size, len(found))))
    return sorted_[np.append(True, sorted_[1:] != sorted_[:-1])]
