"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash.

Every 23-bit word is within 3 bits of exactly one of the 4,096 codewords. A word's keys are the codewords nearest to the
word and to the words one bit away. Two words at most 2 bits apart have a word in their middle, one bit from either, so
they share a key; most words have 6 keys.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 divides x^23 - 1 and generates the code.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def syndrome(word: int) -> int:
    """Remainder of the word by the generator."""
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, of single bits, and the error pattern of each syndrome."""
    bits = np.array([syndrome(1 << i) for i in range(LENGTH)], np.uint32)

    def spread(first: int, n: int) -> np.ndarray:
        out = np.zeros(1 << n, np.uint32)
        for i in range(n):
            out[1 << i : 2 << i] = out[: 1 << i] ^ bits[first + i]
        return out

    errors = np.zeros(1 << CHECKS, np.uint32)
    for a in range(LENGTH):
        for b in range(a, LENGTH):
            for c in range(b, LENGTH):
                word = {1 << a, 1 << b, 1 << c}
                errors[bits[a] ^ (bits[b] if b > a else 0) ^ (bits[c] if c > b else 0)] = sum(word)
    errors[0] = 0
    return spread(0, 12), spread(12, 11), bits, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each word."""
    low, high, _, errors = tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECKS


def keys(words: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For words of so many bits: positions in words and keys, without repeats; the nearest word's key comes first.

    Only the bits in use are flipped: the word in the middle of two short words is short too.
    """
    words = words.astype(np.uint32)
    flipped = np.concatenate([words[:, None], words[:, None] ^ (np.uint32(1) << np.arange(bits, dtype=np.uint32))], axis=1)
    found = nearest(flipped)
    ordered = np.sort(found, axis=1)
    fresh = np.ones(ordered.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at, column = np.nonzero(fresh)
    return at, ordered[at, column]
