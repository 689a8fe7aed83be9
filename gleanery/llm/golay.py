"""The perfect binary Golay code of length 23, as tables for vectorised decoding.

Every 23-bit word lies within 3 bits of exactly one codeword, so two words that differ in
one bit always share a codeword within 3 bits of the one and 4 bits of the other.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA, CHECK = 23, 12, 11
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - CHECK)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; by syndrome the nearest error pattern
    (weight 3 at most) and all patterns of weight 4 at most (rows padded with -1)."""
    single = [_remainder(1 << i) for i in range(LENGTH)]
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for table, base, width in ((low, 0, 12), (high, 12, 11)):
        for x in range(1, 1 << width):
            bit = x.bit_length() - 1
            table[x] = table[x ^ (1 << bit)] ^ single[base + bit]
    patterns: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = e = 0
            for b in bits:
                s ^= single[b]
                e |= 1 << b
            patterns[s].append(e)
    nearest = np.array([p[0] for p in patterns], np.int64)
    all_near = np.full((1 << CHECK, max(map(len, patterns))), -1, np.int64)
    for s, p in enumerate(patterns):
        all_near[s, : len(p)] = p
    return low, high, nearest, all_near


def nearest_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the nearest codeword of each 23-bit word."""
    low, high, nearest, _ = tables()
    return (words ^ nearest[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK


def near_indices(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within 4 bits of each word; rows padded with -1."""
    low, high, _, near = tables()
    patterns = near[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> CHECK)
