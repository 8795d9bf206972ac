"""Distinct word shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

SIZE = 5
K = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """A fixed permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None):
    """Ascending distinct hashes; A-Z count as a-z; fewer than five words: the whole sequence as one; none: empty."""
    import xxhash

    # bytes.lower() changes A-Z only, and bytes.split() splits at the six ASCII blanks only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SIZE, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * K + h[j : j + len(out)]
    return np.unique(mix(out))


def signature(s) -> tuple[int, int]:
    """Two 64-bit numbers that depend on the set alone."""
    if not len(s):
        return 0, 0
    a = mix(s + K)
    return int(a.sum().astype(np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ K)).view(np.int64))
