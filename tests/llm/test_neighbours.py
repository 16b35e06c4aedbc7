import math

import numpy as np

from stopwise.llm import neighbours as m


def brute(rows):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
        x = np.array(v) / max(map(abs, v)) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    n = len(rows)
    links, top = [0] * n, list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(n):
        for b in range(a):
            if unit[a] is None or unit[b] is None or rows[a][2] != rows[b][2] or len(unit[a]) != len(unit[b]):
                continue
            if float(unit[a] @ unit[b]) >= m.THRESHOLD:
                links[a], links[b] = links[a] + 1, links[b] + 1
                top[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a, (i, _, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(n) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, links[a], min(ids, default=None)))
    return sorted(out, key=str)


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for group, (size, spread) in enumerate([(300, 0.02), (60, 0.045), (40, 0.07), (25, 0.09), (1, 0.1)]):
        centre = rng.normal(size=32)
        for _ in range(size):
            rows.append((len(rows), (centre + spread * np.linalg.norm(centre) * rng.normal(size=32) / 2).tolist(), group % 2))
    rows += [(len(rows) + i, rng.normal(size=32).tolist(), i % 3) for i in range(250)]
    same = rows[0][1]
    rows += [
        (2000, None, 0), (2001, [], 0), (2002, [0.0] * 32, 0), (2003, [None, *same[1:]], 0), (2004, same, None),
        (2005, [math.nan, *same[1:]], 0), (2006, [math.inf, *same[1:]], 0), (2007, [1e-200 * x for x in same], 0),
        (2008, same[:5], 0), (2009, [3 * x for x in same[:5]], 0), (None, same, 0), (2010, same, 1), (5, rows[5][1], 1),
        (None, None, None), (2011, [1e200 * x for x in same], 0),
    ]
    return rows


def test_equals_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, u string")
    got, recall = m.near_duplicates(frame)
    found = got.collect()
    assert recall >= m.RECALL
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.component_id is not None)


def test_saturated_lists_are_enlarged(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.01 * rng.normal(size=16)).tolist(), 1) for i in range(1_300)]
    got, _ = m.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(1_299, 0)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    got, recall = m.near_duplicates(empty)
    assert got.collect() == [] and recall == 1.0


def clustered(n, dims=64, clusters=50, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[np.arange(n) % clusters] + 0.7 * rng.normal(size=(n, dims))
    return rng, x / np.linalg.norm(x, axis=1, keepdims=True)


def beside(rng, x, cosine):
    """Vectors at a cosine to x."""
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine * x + math.sqrt(1 - cosine**2) * other


def test_rare_pairs_of_a_large_label_beside_a_large_group(spark):
    # 1 % of planted pairs, and a third of the label in one component.
    rng, x = clustered(12_000)
    planted = beside(rng, x[:120], 0.96)
    group = beside(rng, np.repeat(x[5_000:5_001], 4_000, axis=0), 0.985)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, planted, group]))]
    got, recall = m.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = {r.vec_id: r for r in got.collect()}
    met = sum(found[i].component_id == found[12_000 + i].component_id for i in range(120))
    assert met >= 0.98 * 120 and recall >= m.RECALL
    assert {found[i].component_id for i in (5_000, *range(12_120, 16_120))} == {5_000}


def test_two_saturated_groups_are_linked(spark):
    # Groups of 30 % and 20 % copies, exact or all but exact, at a cosine of 0.95 to each other.
    for noise in (0.0, 1e-4):
        rng, x = clustered(1_000)
        pair = np.concatenate([x[:1], beside(rng, x[:1], 0.95)])
        copies = np.repeat(pair, [600, 400], axis=0)
        copies = copies + noise * rng.normal(size=copies.shape)
        rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([copies, x[1:]]))]
        got, _ = m.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
        found = sorted(got.collect())
        assert {(r.n_links, r.component_id) for r in found[:1_000]} == {(999, 0)}
        assert all(r.kept == (r.vec_id == 0) for r in found[:1_000])


def test_what_attempts_leave_is_compared_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(m, "audit", lambda *_: 0.0)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, _ = m.near_duplicates(frame)
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got.collect()], key=str) == brute(rows)
