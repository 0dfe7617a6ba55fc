"""The binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words.

Every word lies within 3 bits of exactly one codeword. A word's keys are the codewords within 4
bits: one, or six where its own codeword is 3 bits away. Two words that differ in at most 2 bits
share a key (tests go through all cases), so a join on keys finds all such pairs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, CHECK = 0xC75, 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome the least error and five errors of 4 bits (0: none)."""
    single = [_remainder(1 << b) for b in range(LENGTH)]
    spread = lambda bits: np.array([np.bitwise_xor.reduce([single[b + bits[0]] for b in range(len(bits)) if v >> b & 1] or [0]) for v in range(1 << len(bits))], np.int32)
    least, four = np.zeros(1 << CHECK, np.int32), [[] for _ in range(1 << CHECK)]
    for n in range(1, 5):
        for bits in combinations(range(LENGTH), n):
            syndrome = 0
            for b in bits:
                syndrome ^= single[b]
            error = sum(1 << b for b in bits)
            if n < 4:
                least[syndrome] = error
            elif int(least[syndrome]).bit_count() == 3:
                four[syndrome].append(error)
    return spread(range(12)), spread(range(12, 23)), least, np.array([x if len(x) == 5 else [0] * 5 for x in four], np.int32)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six codeword numbers (12 bits) of each word, and whether there are six or only the first."""
    low, high, least, four = tables()
    words = np.asarray(words, np.int32)
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    error = least[syndrome]
    codes = np.concatenate([(words ^ error)[:, None], words[:, None] ^ four[syndrome]], 1)
    return codes >> CHECK, np.bitwise_count(error) == 3
