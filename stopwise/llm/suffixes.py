"""Anchors of byte strings, and merged suffix transforms of the contexts around them (numpy).

Every string of ``LENGTH`` bytes holds an anchor: among the hashes of its ``GRAM``-byte grams, those
that are least in a run of ``RUN`` neighbours (GRAM + RUN - 1 <= LENGTH). Which grams of a string
are anchors by a run inside it depends on the string alone, so both places of a repeated string
have the same anchors. Around an anchor, the strings that hold its gram lie in its context: BEFORE
bytes before it and LENGTH bytes from it on.
"""

from __future__ import annotations

import numpy as np

from stopwise.llm.shingles import STEP, mix

LENGTH = 200
GRAM = 100
RUN = LENGTH - GRAM + 1
BEFORE = LENGTH - GRAM

BASE = int(STEP)
INVERSE = pow(BASE, -1, 2**64)
LETTER = mix(np.arange(1, 257, dtype=np.uint64))
WIDE = np.uint64(0xD1B54A32D192ED03)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i <= n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def _run_least(x: np.ndarray, run: int, least=np.minimum) -> np.ndarray:
    """The least value of every run of ``run`` neighbours."""
    have = 1
    while have < run:
        step = min(have, run - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context hashes of the anchors of a text (bytes)."""
    n = len(text)
    if n < LENGTH:
        none = np.empty(0, np.uint64)
        return np.empty(0, np.int64), none, none
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[text] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = _run_least(grams, RUN)
    edge = np.zeros(RUN - 1, np.uint64)
    # A gram is an anchor when it equals the least of a run that it is in.
    chosen = _run_least(np.concatenate([edge, least, edge]), RUN, np.maximum)
    at = np.flatnonzero(grams == chosen)
    low, high = np.maximum(at - BEFORE, 0), np.minimum(at + LENGTH, n)
    shape = ((at - low) * (LENGTH + 1) + (high - at)).astype(np.uint64)
    contexts = mix((sums[high] - sums[low]) * down[low] + mix(shape))
    return at, grams[at], contexts


# --- contexts of one gram ------------------------------------------------------------------


def side_hashes(rows: list[bytes], width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of padded bytes (nearest to the anchor first), and hashes of its beginnings."""
    flat = b"".join([(r[::-1] if backwards else r).ljust(width, b"\0") for r in rows])
    matrix = np.frombuffer(flat, np.uint8).reshape(len(rows), width)
    hashes = np.zeros((width + 1, len(rows)), np.uint64)
    for i in range(width):
        hashes[i + 1] = hashes[i] * STEP + LETTER[matrix[:, i]]
    return matrix, hashes


def shard(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The suffix order of one shard: by group, then by the words of the suffix."""
    return np.lexsort((*words.T[::-1], group))


def merge(group: np.ndarray, words: np.ndarray, shards: list[np.ndarray], known: int):
    """Merge the suffix orders of shards by refining their interleave.

    At first the shards' suffixes follow each other within a group, of which the first ``known``
    bytes agree. A step looks at the next eight bytes of suffixes that still share a block with
    others: the block falls apart where they differ, and there the common prefix is known. Suffixes
    alone in their block take no part any more; each shard's own order is never sorted again.
    Returns the merged order and the common prefix of each suffix with the one before it (-1 at the
    first of a group).
    """
    order = np.concatenate(shards)
    order = order[np.argsort(group[order], kind="stable")]
    n, depth = len(order), words.shape[1] * 8
    prefix = np.full(n, depth, np.int64)
    prefix[np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])] = -1
    for k in range(known // 8, words.shape[1]):
        starts = prefix < depth
        alone = starts & np.r_[starts[1:], True]
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        block = np.cumsum(starts)[active]
        word = words[order[active], k]
        inside = np.lexsort((word, block))
        order[active], word = order[active][inside], word[inside]
        apart = np.flatnonzero((block[1:] == block[:-1]) & (word[1:] != word[:-1])) + 1
        bits = (word[apart] ^ word[apart - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
        prefix[active[apart]] = 8 * k + (bits != 0).argmax(axis=1)
    return order, prefix


def repeated(
    group: np.ndarray, lefts: list[bytes], rights: list[bytes], sizes: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and greatest l such that the string from l bytes before the
    anchor on is also in another context of its group; -1 where there is none.

    ``sizes`` are the rows of the shards that the contexts come in.
    """
    n = len(group)
    n_left = np.array([len(x) for x in lefts])
    n_right = np.array([len(x) for x in rights])
    _, before = side_hashes(lefts, BEFORE, backwards=True)
    padded = b"".join([r.ljust(LENGTH, b"\0") for r in rights])
    words = np.frombuffer(padded, ">u8").reshape(n, LENGTH // 8).astype(np.uint64)
    bounds = np.cumsum([0, *sizes])
    shards = [
        low + shard(group[low:high], words[low:high])
        for low, high in zip(bounds, bounds[1:], strict=False)
    ]
    order, prefix = merge(group, words, shards, GRAM)
    least, most = np.full(n, -1), np.full(n, -1)
    for back in range(BEFORE, -1, -1):
        depth = LENGTH - back
        # Repeated intervals: neighbours with a common prefix of this depth.
        starts = prefix < depth
        alone = starts & np.r_[starts[1:], True]
        order, prefix, starts = order[~alone], prefix[~alone], starts[~alone]
        if not len(order):
            break
        fits = (n_left[order] >= back) & (n_right[order] >= depth)
        rows, interval = order[fits], np.cumsum(starts)[fits].astype(np.uint64)
        keys = mix(interval * WIDE + before[back][rows])
        by_key = np.argsort(keys)
        same = keys[by_key][1:] == keys[by_key][:-1]
        twice = np.zeros(len(rows), bool)
        twice[by_key[1:][same]] = twice[by_key[:-1][same]] = True
        found = rows[twice]
        most[found] = np.maximum(most[found], back)
        least[found] = back
    return least, most
