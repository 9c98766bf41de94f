"""The binary Golay code of length 23 as a fuzzy hash of 23-bit words.

The code is perfect with radius 3, so each word has one nearest codeword; a word at distance 3 has
five more codewords at distance 4. Taking all codewords within distance 4 as keys (one or six), two
words that differ in at most two bits always share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper twelve bits; for each remainder its error patterns and their number."""
    upper = np.array([_remainder(i << CHECKS) for i in range(1 << (LENGTH - CHECKS))], dtype=np.int64)
    single = [_remainder(1 << i) for i in range(LENGTH)]
    patterns = np.zeros((1 << CHECKS, 6), dtype=np.int64)
    count = np.zeros(1 << CHECKS, dtype=np.int64)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            r = 0
            for p in places:
                r ^= single[p]
            if weight < 4 or count[r] >= 1:
                patterns[r, count[r]] = sum(1 << p for p in places)
                count[r] += 1
    return upper, patterns, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every word; a key is a codeword's upper twelve bits."""
    upper, patterns, count = tables()
    words = words.astype(np.int64)
    rest = upper[words >> CHECKS] ^ (words & ((1 << CHECKS) - 1))
    n = count[rest]
    row = np.repeat(np.arange(len(words)), n)
    which = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (words[row] ^ patterns[rest[row], which]) >> CHECKS
