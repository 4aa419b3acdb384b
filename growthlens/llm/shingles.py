"""Word shingles as sets of 64-bit integers, and their b-bit MinHash signatures (numpy, inside tasks).

Words are what lies between white space (space, tab to carriage return) after A-Z are lower-cased.  A set holds the
distinct runs of ``size`` words; a text with fewer words has its whole word sequence as its one shingle, a text without
words has the empty set.  A shingle is represented by a 64-bit hash of its words.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
MEMO_WORDS = 100_000
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _word(w: bytes) -> int:
    h = _words.get(w)
    if h is None:
        h = xxhash.xxh64_intdigest(w)
        if len(w) <= 64:
            if len(_words) >= MEMO_WORDS:
                _words.clear()
            _words[w] = h
    return h


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(_word, words), U, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, U)
    for k in range(n):
        h = _mix(h * U(0x9E3779B97F4A7C15) + w[k:len(w) - n + 1 + k])
    return np.unique(h)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set: equal sets have equal names."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    a = np.frombuffer(d, np.int64)
    return int(a[0]), int(a[1])


def multipliers32(n: int, seed: int) -> np.ndarray:
    return (_mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) >> U(32)).astype(np.uint32) | np.uint32(1)


def least(s: np.ndarray, mult: np.ndarray, block: int = 2048) -> np.ndarray:
    """The MinHash value of a set under each multiplier, 32 bits, well mixed."""
    x = (s >> U(32)).astype(np.uint32)
    out = np.full(len(mult), 2**32 - 1, np.uint32)
    for a in range(0, len(x), block):
        y = x[a:a + block][:, None] * mult
        y ^= y >> np.uint32(15)
        np.minimum(out, y.min(axis=0), out=out)
    return (_mix(out.astype(U) * U(0x9E3779B97F4A7C15)) & U(0xFFFFFFFF)).astype(np.uint32)


def joined(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets with different labels whose similarity is at least ``percent``; only those that join two groups of
    labels for the first time."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    holders = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(grams)))])
    at = np.cumsum(sizes) - sizes
    root = {label: label for label in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs = []
    for i in range(len(sets)):
        mine = inverse[at[i]:at[i] + sizes[i]]
        count = begin[mine + 1] - begin[mine]
        spots = np.repeat(begin[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(holders[spots], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
            a, b = find(labels[i]), find(labels[j])
            if a != b:
                root[a] = b
                pairs.append((i, j))
    return pairs
