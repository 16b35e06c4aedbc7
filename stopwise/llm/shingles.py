"""Word shingles of texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

SIZE = 5

#: Odd multipliers of the 64-bit finalizer that MurmurHash3 publishes, and an odd number for rows.
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
STEP = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> HALF)) * MIX_1
    x = (x ^ (x >> HALF)) * MIX_2
    return x ^ (x >> HALF)


#: White space between words; A-Z as lower case.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A number for each byte, A-Z as lower case; none for white space.
LETTER = mix(np.char.lower(np.arange(256, dtype=np.uint8).view("S1")).view(np.uint8).astype(np.uint64) * STEP + MIX_1)
LETTER[0] = mix(MIX_2[None])[0]
LETTER[SPACE] = 0
#: Powers of an odd number and of its inverse modulo 2**64, as many as the longest text needed.
BASE = int(STEP) | 3
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: Bytes of a text that are hashed at a time, to the next white space.
PIECE = 1 << 20


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            grown = np.full(1 << n.bit_length(), base, np.uint64)
            grown[0] = 1
            _powers[i] = np.cumprod(grown)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of what stands between ASCII white space, with A-Z in lower case."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) <= PIECE:
        return _word_hashes(data)
    space, found, low = np.flatnonzero(SPACE[data]), [], 0
    while low < len(data):
        i = int(np.searchsorted(space, low + PIECE))
        high = int(space[i]) if i < len(space) else len(data)
        found.append(_word_hashes(data[low:high]))
        low = high
    return np.concatenate(found)


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of letters times powers of their places, over all bytes at once; a word is the difference
    of two sums, moved to the first place."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * MIX_2)


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of all words if there are fewer."""
    one = word_hashes(text)
    if not len(one):
        return one
    n = min(size, len(one))
    out = np.zeros(len(one) - n + 1, np.uint64)
    for i in range(n):
        out = out * STEP + one[i : len(one) - n + 1 + i]
    # Shorter sequences are sets of their own kind.
    return np.unique(mix(out + np.uint64(n)))
