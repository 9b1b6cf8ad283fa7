"""Words of texts and hashes of runs of words, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; none for null."""
    return text.encode("utf-8").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> np.uint64(32))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours; order counts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out + hashes[k : k + n])
    return out


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(size, len(words))))
