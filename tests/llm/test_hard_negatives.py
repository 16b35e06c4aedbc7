import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm import hard_negatives as m


def brute(rows):
    """The definition, over rows (vec_id, label, vector or None)."""
    kept = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, (a, label, x) in enumerate(kept):
        if a % 100:
            continue
        every = [(-sum(p * q for p, q in zip(x, y)), b, other == label) for j, (b, other, y) in enumerate(kept) if j != i]
        every.sort()
        for p, positive, _ in [e for e in every if e[2]][:5]:
            fits = [(n, b) for n, b, same in every if not same and -30 * p <= -100 * n <= -90 * p][:10]
            out += [(a, positive, r, b, -p, -n) for r, (n, b) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("block", F.lit(1))
    found = m.hard_negatives(df, F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in found.collect())


def clustered(seed, n, width=16, labels=4):
    """Vectors around a few centres, which mix labels, scaled so that norms differ."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, width))
    x = middle[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, width))
    x *= r.uniform(0.2, 1.5, n)[:, None] / np.linalg.norm(x, axis=1)[:, None]
    return [(i, int(r.integers(0, labels)), v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize("leaf", [120, 5_000])
def test_against_brute_force(spark, monkeypatch, leaf):
    """With many blocks on several levels, and with one."""
    monkeypatch.setattr(m, "LEAF", leaf)
    rows = clustered(1, 900)
    expected = brute(rows)
    assert len(expected) > 300 and run(spark, rows) == expected


def test_copies_ties_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(m, "LEAF", 150)
    rows = clustered(2, 500)
    hot = rows[0][2]
    # A third of all rows is one vector, in two labels; ids repeat; whole groups tie.
    rows += [(1_000 + 10 * i, i % 2, hot) for i in range(250)]
    rows += [(100, rows[100][1], rows[100][2]), (100, 3, rows[7][2]), (205, 1, [0.5] * 16), (206, 2, [0.5] * 16)]
    expected = brute(rows)
    assert run(spark, rows) == expected


def test_odd_vectors(spark):
    rows = clustered(3, 150)
    rows += [
        (None, 1, [1.0] * 16), (300, None, [1.0] * 16), (400, 1, None), (500, 2, [math.nan] * 16), (600, 2, [math.inf] * 16),
        (700, 1, [None] + [1.0] * 15), (800, 1, []), (900, 1, [0.5] * 3), (1000, 2, [-1.0] * 16), (1100, 3, [1.0] * 20),
        (1200, 9, [1.0] * 16), (1300, 1, [0.0] * 16),
    ]
    assert run(spark, rows) == brute(rows)


def test_scores_beyond_exact_doubles(spark):
    r = np.random.default_rng(4)
    rows = [(100 * i, i % 2, (r.normal(size=4) * 900_000).astype(np.float32).tolist()) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []


def test_bounds_hold_and_prune():
    """No inner product lies outside its node's bounds, and the descent verifies few candidates."""
    rows = clustered(5, 2_000, width=8)
    x = np.floor(256 * np.array([v for _, _, v in rows]))
    norm = (x**2).sum(axis=1)
    few = [
        {"label": str(label), "ids": [i], "x": v.astype(np.int64).tobytes(), "norm": n}
        for (i, label, _), v, n in zip(rows, x, norm, strict=True)
    ]
    block = m.Block(few, norm.max(), 8)
    low, high = m.bounds(x[:50], norm[:50], block.centres, block.radii, block.most)
    score = x[:50] @ x.T

    def under(node):
        below = [c for c, parent in enumerate(block.parent) if parent == node]
        return block.own[node] if not below else np.concatenate([under(c) for c in below])

    assert len(block.leaves) > 20 and sorted(under(0)) == list(range(2_000))
    for node in range(len(block.centre)):
        inside = score[:, under(node)]
        assert (inside >= low[:, [node]]).all() and (inside <= high[:, [node]]).all()

    class Counted:
        """The candidates' vectors, counting those that are looked at."""

        seen = 0

        def __getitem__(self, at):
            Counted.seen += len(at)
            return x[at]

    block.x = Counted()
    low, high, order = block.leaf_bounds(x[:50], norm[:50])
    for i in range(50):
        own = [j for j in range(2_000) if few[j]["label"] == few[i]["label"]]
        every = sorted((-int(score[i, j]), j) for j in own)
        middle = -every[40][0]
        windows = [(-math.inf, math.inf), (-math.inf, middle)]
        for each in (windows[:1], windows):
            found = block.search(x[i], low[i], high[i], order[i], few[i]["label"], True, each, 6)
            assert found == [[e for e in every if -e[0] <= w[1]][:6] for w in each]
    assert Counted.seen < 0.6 * 2 * 50 * 2_000


def test_far_apart_and_nearest():
    x = np.array([[0.0], [1.0], [10.0], [10.0], [4.0]])
    assert m.far_apart(x, 9).tolist() == [0, 2, 4, 1]
    at, distance = m.nearest(x, x[[0, 2]])
    assert at.tolist() == [0, 0, 1, 1, 0] and distance.tolist() == [0, 1, 0, 0, 4]
