import random

import numpy as np
import pytest

from stopwise.llm import graph as m


def brute(edges):
    label = {x: x for a, b in edges if a != b for x in (a, b)}
    while True:
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def edges_of(seed):
    rng = random.Random(seed)
    found = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)]
    chain = list(range(1_000, 1_300))
    rng.shuffle(chain)
    star = [(5_000, x) for x in range(4_900, 5_100)]
    return [*found, *zip(chain, chain[1:]), *star, *star[:50], (-(2**63), 2**63 - 1), (7_000, 7_000)]


def test_forest_of_a_part():
    for seed in range(5):
        edges = edges_of(seed)
        a, b = np.array([e for e in edges if e[0] != e[1]], np.int64).T
        node, label = m.forest(a, b)
        assert dict(zip(node.tolist(), label.tolist())) == brute(edges)
        assert node.tolist() == sorted(node.tolist())


@pytest.mark.parametrize("part", [1_000_000, 90])
def test_components_by_parts(spark, monkeypatch, part):
    """Few edges are one part and one written round; many parts are joined by rounds."""
    tables = []
    monkeypatch.setattr(m, "EDGES", part)
    monkeypatch.setattr(m, "stored", lambda df, label, f=m.stored: tables.append(label) or f(df, label))
    edges = edges_of(9)
    found = m.components(spark.createDataFrame([*edges, (None, 3), (8_000, None)], "a long, b long")).collect()
    assert {r.node: r.label for r in found} == brute(edges)
    assert len(found) == len({r.node for r in found})
    if part == 1_000_000:
        assert tables == ["edges", "labels"]
    else:
        assert len(tables) > 3


def test_no_edges(spark):
    assert m.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
