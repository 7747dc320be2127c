"""Sets of word shingles, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``shingle`` words; a shorter text is one run, and one without words has none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if n else [], np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[s:e], 42) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def set_name(own: np.ndarray) -> bytes:
    """Names a set by 128 bits."""
    return xxhash.xxh128_digest(own.tobytes(), 7)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
