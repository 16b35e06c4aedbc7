import math
import zlib

import numpy as np
from tokenizers import Tokenizer

from stopwise.llm import packing as m
from stopwise.llm.words import default_path


def check(rows, capacity):
    """Every sequence is gapless and within capacity; returns their number."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_pieces_hold_the_ids_and_sequences_fit(spark, odd_docs):
    rows = m.pack(odd_docs, capacity=64).collect()
    check(rows, 64)
    library = Tokenizer.from_file(default_path())
    expected = []
    for i, text in odd_docs.select("doc_id", "text").collect():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n in range(math.ceil(len(ids) / 64)):
            part = ids[64 * n : 64 * n + 64]
            expected.append((i, n, 64 * n, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_regions_are_pooled_and_close_to_the_least_number(spark):
    lengths = np.random.default_rng(1).integers(1, 90, 3_000).tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    packed = m.pack_items(items, capacity=100, region=512).collect()
    assert sorted(r.row for r in packed) == list(range(3_000))
    filled = {}
    for r in packed:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 100
    assert len(filled) <= 1.01 * math.ceil(sum(lengths) / 100)


def test_crossover_keeps_every_item_once_and_evolution_does_not_lose():
    rng = np.random.default_rng(3)
    lengths = rng.integers(20, 70, 200).astype(np.int64)
    start = m.place(lengths, np.full(200, -1), 100)
    other = m.mutate(lengths, start, 100, rng)
    child = m.crossover(lengths, start, other, 100, rng)
    for group in (start, other, child):
        assert group.min() == 0 and m.fill(lengths, group).max() <= 100
        assert set(group) == set(range(group.max() + 1))
    best = m.evolve(lengths, [start], 100, 40, rng)[0]
    assert m.worth(lengths, best, 100) <= m.worth(lengths, start, 100)


def test_empty_table(spark, no_docs):
    assert m.pack(no_docs).collect() == []
