import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from stopwise.llm import prefix_trie as m

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(turns, family=True):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if family else 0
        convs[c] = own.get(c - c % 5, [])[:h] + seq[h:]
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, convs_of in members.items():
        gain = (len(convs_of) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    out = []
    for p, convs_of in members.items():
        ends = ",".join(map(str, sorted(c for c in convs_of if len(convs[c]) == len(p))))
        out.append((
            min(convs_of), len(p), min(members[p[:-1]]) if p else None, len(convs_of), children[p], leaves[p],
            saved[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def some(seed, n=120):
    """Conversations of few different turns, so that prefixes branch, end inside others and repeat."""
    r = random.Random(seed)
    out = []
    for c in r.sample(range(2 * n), n):
        for turn in range(r.choice([1, 2, 3, 5, 12])):
            out.append((c, turn, r.choice(["user", None]), r.choice(["a", "bé", "", None])))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rebuilt_conversations_against_brute_force(spark, seed):
    turns = some(seed)
    assert rows(m.trie(m.rebuilt(m.sequences(frame(spark, turns))))) == brute(turns)


def test_many_ranges_are_merged_across_their_boundaries(spark):
    """As many ranges as rows, some with one row, and one prefix that runs through most of them."""
    turns = some(5, 60) + [(c, t, "user", "long" if t < 6 else f"{c}") for c in range(1000, 1040) for t in range(8)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = rows(m.trie(m.sequences(frame(spark, turns))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == brute(turns, family=False)


def test_every_boundary_of_a_forest(spark):
    """Any cut of sorted sequences into ranges gives the same sums per prefix."""
    r = random.Random(3)
    seqs = sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(40)})
    keys = [b"".join(hashlib.md5(c.encode()).digest() for c in s) for s in seqs]
    keys.sort()

    def merged(cuts):
        total = defaultdict(lambda: [0, 10**9, 0, 0, 0])
        for low, high in zip(cuts, cuts[1:]):
            f = m._Forest(keys[low - 1] if low else None, keys[high] if high < len(keys) else None)
            for i in range(low, high):
                f.add(keys[i], [3] * (len(keys[i]) // 16), 2, i, f"e{i}")
            f.grow()
            for x in range(len(f.into)):
                if f.into[x] == x:
                    t = total[f.keys[f.row[x]][: 16 * f.depth[x]]]
                    t[0] += f.n[x]
                    t[1] = min(t[1], f.least[x])
                    t[2] += f.children[x]
                    t[3] += f.leaves[x]
                    t[4] += f.saved[x]
        return {k: tuple(v) for k, v in total.items()}

    whole = merged([0, len(keys)])
    assert len(whole) == len({k[: 16 * d] for k in keys for d in range(len(k) // 16 + 1)})
    for cut in range(1, len(keys)):
        assert merged([0, cut, len(keys)]) == whole
    assert merged(list(range(len(keys) + 1))) == whole


def test_large_group_of_copies_and_null_and_turnless(spark):
    copies = [(c, t, "user", f"x{t}") for c in range(0, 30_000, 5) for t in range(2)]
    odd = [(None, 0, "user", "x0"), (7, None, None, None), (7, None, None, None), (7, 0, "user", "é")]
    odd += [(c, t, "user", f"own {c}") for c in range(100_001, 100_030, 5) for t in range(3)]
    turns = copies + odd
    assert rows(m.trie(m.rebuilt(m.sequences(frame(spark, turns).withColumn("least", m.F.lit(1)))))) == brute(turns)


def test_empty(spark):
    assert rows(m.trie(m.rebuilt(m.sequences(frame(spark, []))))) == []
