"""Extended binary Golay code (24, 12, 8) as a tolerant hash of short bit strings.

Every 24-bit word has either one nearest codeword (distance 0 to 3) or six
at distance 4. Two words that differ in at most one bit always share a nearest
codeword: one of them has odd weight, so it lies 1 or 3 from a single codeword,
and flipping a bit keeps that codeword among the nearest of the other. So the
indices of the nearest codewords are one to six keys that find all words one
error away.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
KEYS = 6


def _parity(message: int) -> int:
    """The 12 check bits: 11 of the cyclic code and one for even weight."""
    rest = message << 11
    for i in range(22, 10, -1):
        if rest >> i & 1:
            rest ^= GENERATOR << (i - 11)
    word = (message << 11) | rest
    return (rest << 1) | (word.bit_count() & 1)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of each message, the error patterns of each syndrome (six
    columns, repeated where there is one), and how many there are."""
    parity = np.array([_parity(m) for m in range(4096)], dtype=np.uint32)
    errors: list[list[int]] = [[] for _ in range(4096)]
    for weight in range(5):
        for bits in combinations(range(24), weight):
            word = sum(1 << b for b in bits)
            syndrome = (word & 0xFFF) ^ int(parity[word >> 12])
            if not errors[syndrome] or errors[syndrome][0].bit_count() == weight:
                errors[syndrome].append(word)
    count = np.array([len(e) for e in errors])
    filled = np.array([(e * KEYS)[:KEYS] for e in errors], dtype=np.uint32)
    return parity, filled, count


def nearest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (0 to 4095) of the nearest codewords of each word: an array of
    six columns, and how many of them count (one or six)."""
    parity, errors, count = tables()
    words = words.astype(np.uint32)
    syndrome = (words & 0xFFF) ^ parity[words >> 12]
    return (words[:, None] ^ errors[syndrome]) >> 12, count[syndrome]
