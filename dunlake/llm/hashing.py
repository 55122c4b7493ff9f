"""Vectorised hashing of words, shingles and byte windows.

A text is hashed by the prefix sums of a polynomial modulo 2^64 with random byte values, so the hash of any
substring is one subtraction and one product. Results are mixed before use. Long words and lines are hashed by BLAKE2
instead, as such a polynomial gives some long texts equal hashes whatever its base.
"""

from __future__ import annotations

import hashlib

import numpy as np

from dunlake.llm.common import Slice

_RNG = np.random.Generator(np.random.PCG64(20240502))
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
MULTIPLIERS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = {BASE: np.ones(1, np.uint64), BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i below n; grows by doubling and is kept by the worker."""
    known = _powers[base]
    while len(known) < n:
        known = np.concatenate((known, known * np.uint64(pow(base, len(known), 1 << 64))))
        _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial, with a leading zero."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the ranges, including their lengths."""
    raw = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * MULTIPLIERS[63])


#: Ranges of more bytes are hashed one by one. Few words are as long, and the calls are at most one for so many bytes.
LONG_BYTES = 32


def text_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of ranges of a byte array, by which words and lines are told apart; ``lower`` takes A-Z as a-z."""
    hashes = range_hashes(prefix_sums((LOWER_VALUES if lower else BYTE_VALUES)[data]), starts, ends)
    long = np.flatnonzero(ends - starts > LONG_BYTES)
    if len(long):
        whole = memoryview(np.ascontiguousarray(LOWER_BYTES[data] if lower else data))
        digests = b"".join(
            hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        )
        hashes[long] = np.frombuffer(digests, "<u8")
    return hashes


def word_bounds(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slice, and for each text the number of words before it."""
    n = len(part.data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(part) + 1, np.int64)
    inner = ~IS_SPACE[part.data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inner[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inner[1:]
    edges = part.offsets[:-1]
    before[edges[edges < n]] = True
    ends = part.offsets[1:]
    after[ends[ends > 0] - 1] = True
    starts = np.flatnonzero(inner & before)
    return starts, np.flatnonzero(inner & after) + 1, np.searchsorted(starts, part.offsets)


def word_hashes(part: Slice, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and for each text the number of words before it."""
    starts, ends, first = word_bounds(part)
    return text_hashes(part.data, starts, ends, lower), first


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by the place of its first word; runs may cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * MULTIPLIERS[0]
    for k in range(1, size):
        total += words[k : k + n] * MULTIPLIERS[k]
    return mix(total)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts of a slice and each one's text number.

    A text with fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    grams = gram_hashes(words, size)
    kept = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), kept)
    start = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(kept)[:-1])), kept) + np.arange(kept.sum())
    values = grams[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            more[has] += words[first[short[has]] + k] * MULTIPLIERS[k]
        more = mix(more + counts[short].astype(np.uint64) * MULTIPLIERS[62])
        values, owner = np.concatenate((values, more)), np.concatenate((owner, short))
    return values, owner
