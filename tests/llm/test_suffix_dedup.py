import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import suffix_dedup as m
from stopwise.llm import suffixes as s


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in texts:
        for p in range(len(b) - 199):
            seen[b[p : p + 200]] = seen.get(b[p : p + 200], 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        runs = sum(1 for p, x in enumerate(gone) if x and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(c for c, x in zip(b, gone, strict=True) if not x)))
    return sorted(out, key=str)


def passages():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices("abcdefghij  é", k=n))
    shared = [text(n) for n in (150, 199, 200, 201, 260, 700)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 500))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.choice([0, 0, 1, 17])
            parts += [p[a : len(p) - rng.choice([0, 0, 3])], text(rng.randint(0, 90))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 199), (101, "b" * 200), (102, "b" * 200), (103, "c" * 201), (104, "d" * 900)]
    rows += [(105, "e" * 199 + "f" + "e" * 199), (106, "xy" * 300), (107, "\0" * 150 + "q"), (108, "\0" * 260)]
    rows += [(109, "é" * 150), (110, "z" + "é" * 150), (111, rows[5][1]), (None, rows[6][1]), (6, rows[6][1])]
    return rows


@pytest.mark.parametrize("many", [m.MANY, 2])
def test_equals_brute_force(spark, many):
    rows = passages()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, own string")
    got = m.keep(docs, many).select(
        "doc.doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), "kept"
    )
    found = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()]
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 10_000
    assert sorted(found, key=str) == expected


def test_merged_orders_are_the_order_of_all_suffixes():
    rng = np.random.default_rng(4)
    texts = [b"k" * s.GRAM + bytes(rng.integers(97, 99, 100).astype(np.uint8)) for _ in range(90)]
    texts[40:60] = texts[:20]
    words = np.frombuffer(b"".join(texts), ">u8").reshape(90, -1).astype(np.uint64)
    group = rng.integers(0, 3, 90)
    shards = [low + s.shard(group[low : low + 30], words[low : low + 30]) for low in (0, 30, 60)]
    order, prefix = s.merge(group, words, shards, s.GRAM)
    assert [(group[i], texts[i]) for i in order] == sorted((group[i], texts[i]) for i in range(90))
    for n in range(1, 90):
        a, b = order[n - 1], order[n]
        common = next((k for k in range(200) if texts[a][k] != texts[b][k]), 200)
        assert prefix[n] == (common if group[a] == group[b] else -1)


def test_every_window_has_an_anchor_that_depends_on_it_alone():
    rng = np.random.default_rng(9)
    window = rng.integers(0, 4, s.LENGTH).astype(np.uint8)
    places = []
    for _ in range(50):
        before, after = rng.integers(0, 300, 2)
        text = np.concatenate([rng.integers(0, 4, before), window, rng.integers(0, 4, after)]).astype(np.uint8)
        at, _, _ = s.anchors(text)
        places.append({int(a) - before for a in at if before <= a <= before + s.LENGTH - s.GRAM})
    assert set.intersection(*places)


def test_texts_keep_columns_and_whole_characters(spark, odd_docs, no_docs):
    left = m.drop_repeats(odd_docs)
    assert left.columns == odd_docs.columns
    rows = {r.doc_id: r for r in left.where("doc_id is not null").collect()}
    assert rows[6].text == "" and rows[7].text == rows[7].text.strip("w") != ""
    assert rows[1].text == "a b c d e f g h i j" and rows[3].text == ""
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert m.drop_repeats(no_docs).collect() == []
