"""Words and word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> _SHIFT)
    x *= _A
    x ^= x >> _SHIFT
    x *= _B
    x ^= x >> _SHIFT
    return x


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between blanks, tabs and line ends, with A to Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, in order; of fewer words, one hash of all; of none, none."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, dtype=np.uint64)
    for j in range(size):
        out = mix(out * _STEP + words[j : j + count])
    return out


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(sequence_hashes(word_hashes(text), size))
