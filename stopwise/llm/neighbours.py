"""Embedding near-duplicates by NN-descent.

Vectors are compared only within their label. Equal vectors are one node with a weight; its name is
the 64-bit hash of label and vector, so naming it needs no join. Every node keeps a list of its
``LIST`` nearest ones found so far. Lists start from leaves of random projections, which take as many
planes as bring them to ``BLOCK`` times the logarithm of the label's nodes, and whose nodes are
compared among themselves. In each round the neighbours of a node, in both directions, are compared
with each other (neighbours of neighbours), and lists take what is nearer, until no more than
``CHANGED`` of their entries are new. A node with many reverse neighbours lends at most about ``LENT``
of them to a round, chosen anew each time.

All pairs that reach the threshold on the way join components, also those that no list has room for;
of each leaf or neighbourhood only a spanning forest of its links is kept. Further attempts look
outward: lists then hold only nodes of other components, so a group that fills its own lists still
meets the groups beside it. Lists are then enlarged to the whole component, in blocks: pairs of
blocks whose centres and radii decide every pair (all link or none) are counted without comparing
vectors, others are compared.

An attempt with new projections is the last one when it adds a link to at most 1 - ``RECALL`` of the
linked nodes outside large components, and an audit agrees: nodes without a component, of small and
of large components are compared with all of their label, and the mean recall per node that has
links, of those in large components and of all others, is at least ``RECALL``. What ``ATTEMPTS``
attempts do not settle is compared pair by pair.

Cosines are those of double precision. Defined cases: null labels, null, empty and zero vectors and
those with null or non-finite components link with nothing; vectors of different lengths are apart;
a null vec_id takes part and is no component_id unless a component has no other; rows that repeat a
vec_id are vectors of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import release, stored, table
from stopwise.llm.graph import components

THRESHOLD = 0.93
LIST = 12
LENT = 12
BLOCK = 128
#: Planes are taken in steps until a leaf is small enough, this many at most.
STEP = 2
PLANES = 40
TREES = 2
CHANGED = 0.02
#: Rows of a block of a component.
ENLARGED = 512
#: Nodes that the audit takes of large components (more than ``SMALL`` nodes), of small ones and of
#: those without one, and the recall it asks for.
AUDIT = 256
AUDIT_APART = 2_048
SMALL = LIST + 1
RECALL = 0.98
ATTEMPTS = 4
#: Vectors repeated by more than one row in so many are broadcast.
COMMON = 1_000
#: Safety of decisions by centres and radii, in radians.
MARGIN = 1e-7


def _vectors(rows: DataFrame) -> DataFrame:
    """u (hash of part and x), vec_id, part (label and length), x (unit, doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, parts = [], [], []
            for vec_id, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = None
                if label is not None and v and not any(e is None for e in v):
                    x = np.array(v, np.float64)
                    # Scaled first, so that squares neither vanish nor overflow.
                    top = np.abs(x).max()
                    norm = np.linalg.norm(x / top) if np.isfinite(top) and top > 0 else 0.0
                    # Adding 0 makes a negative zero a zero.
                    x = x / top / norm + 0.0 if norm > 0 and np.isfinite(norm) else None
                ids.append(vec_id)
                labels.append(None if x is None else f"{label}/{len(x)}")
                parts.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(parts, pa.binary())],
                names=["vec_id", "part", "x"],
            )

    found = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    found = found.mapInArrow(run, "vec_id long, part string, x binary")
    return stored(found.withColumn("u", F.when(F.col("x").isNotNull(), F.xxhash64("part", "x"))), "vectors")


def _nodes(every: DataFrame) -> DataFrame:
    """u, part, x, weight (its rows) and least (its smallest vec_id) of every distinct vector."""
    found = every.where("x is not null").groupBy("u").agg(
        F.first("part").alias("part"), F.first("x").alias("x"), F.count("*").alias("weight"),
        F.min("vec_id").alias("least"),
    )
    return stored(found, "nodes")


def _matrix(x) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in x])


def _leaves(vectors: DataFrame, seed: int) -> DataFrame:
    """u, x, label, block: leaves of random projections, each of one part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            code = np.zeros(len(frame), np.int64)
            size = frame["x"].str.len().to_numpy()
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                planes = np.random.default_rng([seed, int(width)]).normal(size=(width // 8, PLANES))
                bits = _matrix(frame["x"].iloc[own]) @ planes > 0
                code[own] = bits @ (1 << np.arange(PLANES)[::-1])
            yield frame[["u", "part"]].assign(code=code)

    codes = stored(vectors.select("u", "part", "x").mapInPandas(run, "u long, part string, code long"), "codes")
    levels = F.array(*[
        F.struct(F.lit(d).alias("level"), F.shiftright("code", PLANES - d).alias("prefix"))
        for d in range(0, PLANES + 1, STEP)
    ])
    # Prefixes of codes that hold too many nodes are few: nodes / BLOCK at each level at most.
    every = codes.select("u", "part", F.explode(levels).alias("p")).select("u", "part", "p.level", "p.prefix")
    sizes = every.groupBy("part", "level", "prefix").agg(F.count("*").alias("n"))
    parts = codes.groupBy("part").agg((BLOCK * F.ceil(F.log2(F.count("*") + 1))).alias("most"))
    hot = stored(sizes.where(F.col("n") > BLOCK).join(parts, "part").where("n > most"), "large-leaves")
    deepest = every.join(hot, ["part", "level", "prefix"]).groupBy("u").agg(
        F.max(F.struct("level", "n", "most")).alias("d")
    )
    # A leaf that all planes leave too large is dealt out to blocks; each level is a plane more.
    level = F.least(F.coalesce(F.col("d.level") + STEP, F.lit(0)), F.lit(PLANES))
    chunks = F.when(F.col("d.level") == PLANES, F.ceil(F.col("d.n") / F.col("d.most"))).otherwise(1)
    block = F.concat_ws(
        "/", "part", level, F.expr("shiftright(code, rest)"), F.pmod(F.xxhash64("u", F.lit(seed)), chunks)
    )
    named = codes.join(deepest, "u", "left").withColumn("rest", (PLANES - level).cast("int"))
    named = named.select("u", block.alias("block"))
    return vectors.join(named, "u").select("u", "x", "label", "block")


def _spanning(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and first members of the components of a symmetric matrix of links."""
    top = np.full(len(hits), -1)
    for first in np.flatnonzero(hits.sum(axis=1) > hits.diagonal()):
        if top[first] < 0:
            new = np.array([first])
            while len(new):
                top[new] = first
                new = np.flatnonzero(hits[new].any(axis=0) & (top < 0))
    members = np.flatnonzero((top >= 0) & (top != np.arange(len(hits))))
    return members, top[members]


_PAIRS = "u long, v long, cosine double, linked boolean"


def _first_lists(vectors: DataFrame, seed: int) -> DataFrame:
    """u, v, cosine, linked: the nearest of each node outside its component (label) in its leaf, in
    one direction, and a spanning forest of the links of the leaf."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("u")
        x, u, label = _matrix(frame["x"]), frame["u"].to_numpy(), frame["label"].to_numpy()
        k = min(LIST, len(u) - 1)
        if k < 1:
            return pd.DataFrame({"u": [], "v": [], "cosine": [], "linked": []}).astype(
                {"u": "int64", "v": "int64", "cosine": "float64", "linked": "bool"}
            )
        hits = np.zeros((len(u), len(u)), bool)
        out = []
        # In strips, so that a large leaf holds few numbers at a time.
        for low in range(0, len(u), ENLARGED):
            i = np.arange(low, min(low + ENLARGED, len(u)))
            cosine = x[i] @ x.T
            hits[i] = cosine >= THRESHOLD
            cosine[label[i][:, None] == label] = -2
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k].ravel()
            at = np.repeat(i, k)
            found = cosine[at - low, near]
            own = found > -2
            out.append((u[at[own]], u[near[own]], found[own]))
        a, b = _spanning(hits | hits.T)
        once = label[a] != label[b]
        u_, v, cosine = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.concat([
            pd.DataFrame({"u": u_, "v": v, "cosine": cosine, "linked": False}),
            pd.DataFrame({"u": u[a[once]], "v": u[b[once]], "cosine": 1.0, "linked": True}),
        ])

    return _leaves(vectors, seed).groupBy("block").applyInPandas(run, _PAIRS)


def _best(pairs: DataFrame) -> DataFrame:
    """The lists: of distinct pairs (u, v, cosine) the nearest LIST of each u."""
    once = pairs.groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cosine"), "v"))
    return once.withColumn("n", rank).where(F.col("n") <= LIST).drop("n")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups, of batches that are sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(0).to_numpy()
        split = int(np.searchsorted(keys, keys[-1]))
        if split:
            yield whole.slice(0, split)
        held = whole.slice(split).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _round(vectors: DataFrame, lists: DataFrame, seed: int) -> DataFrame:
    """u, v, cosine, linked: neighbours' neighbours of other components that enter a list, and a
    spanning forest of the links of each neighbourhood."""
    worst = lists.groupBy("u").agg(F.min("cosine").alias("worst"), F.count("*").alias("n"))
    worst = worst.select("u", F.when(F.col("n") < LIST, F.lit(-2.0)).otherwise(F.col("worst")).alias("worst"))
    into = lists.groupBy("v").agg(F.count("*").alias("n"))
    lent = lists.join(into, "v").where(
        F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.greatest("n", F.lit(1))) < LENT
    )
    around = (
        lists.select(F.col("u").alias("pivot"), F.col("v").alias("u"))
        .unionByName(lent.select(F.col("v").alias("pivot"), "u"))
        .unionByName(worst.select(F.col("u").alias("pivot"), "u"))
        .distinct()
    )
    narrow = vectors.select("u", "x", "label").join(worst, "u")
    around = around.join(narrow, "u").select("pivot", "u", "worst", "x", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches):
            pivot = group.column("pivot").to_numpy()
            u, worst = group.column("u").to_numpy(), group.column("worst").to_numpy()
            label = group.column("label").to_numpy()
            x = _padded(group.column("x").to_pylist())
            first = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
            sizes = np.diff(np.r_[first, len(pivot)])
            out = []
            # Groups of one size are compared together.
            for size in np.unique(sizes):
                if size < 2:
                    continue
                at = first[sizes == size][:, None] + np.arange(size)
                i, j = np.triu_indices(size, 1)
                for low in range(0, len(at), 2_000):
                    rows = at[low : low + 2_000]
                    square = np.matmul(x[rows], x[rows].transpose(0, 2, 1))
                    cosine = square[:, i, j]
                    a, b = rows[:, i], rows[:, j]
                    new = (cosine > np.minimum(worst[a], worst[b])) & (label[a] != label[b])
                    out.append((u[a[new]], u[b[new]], cosine[new], np.zeros(new.sum(), bool)))
                    hits = square >= THRESHOLD
                    hits |= hits.transpose(0, 2, 1) | np.eye(size, dtype=bool)
                    top, before = np.tile(np.arange(size), (len(rows), 1)), None
                    while before is None or (top != before).any():
                        before = top
                        top = np.where(hits, top[:, None, :], size).min(axis=2)
                    a, b = rows, np.take_along_axis(rows, top, axis=1)
                    new = (a != b) & (label[a] != label[b])
                    out.append((u[a[new]], u[b[new]], np.ones(new.sum()), np.ones(new.sum(), bool)))
            if out:
                a, b, c, linked = (np.concatenate(z) for z in zip(*out, strict=True))
                low, high = np.minimum(a, b), np.maximum(a, b)
                once = np.unique(np.stack([low, high, linked]), axis=1, return_index=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[once]), pa.array(high[once]), pa.array(c[once]), pa.array(linked[once])],
                    names=["u", "v", "cosine", "linked"],
                )

    sorted_rows = around.repartition("pivot").sortWithinPartitions("pivot")
    return sorted_rows.mapInArrow(run, _PAIRS)


def _padded(rows: list[bytes]) -> np.ndarray:
    """Vectors as a matrix; those of other lengths, of other parts, are padded with zeros, which
    change no product."""
    width = max(map(len, rows))
    return np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.float64).reshape(len(rows), -1)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))


def descend(vectors: DataFrame, lists: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """Lists after new leaves and rounds until few entries change, and links met on the way that
    join components (the label of vectors)."""
    start = _first_lists(vectors, 100 * seed)
    for t in range(1, TREES):
        start = start.unionByName(_first_lists(vectors, 100 * seed + t))
    start = stored(start, "leaf-pairs")
    links = start.where("linked").select("u", "v")
    first = start.where("not linked").select("u", "v", "cosine")
    if lists is not None:
        # Of earlier lists what is still in another component.
        label = vectors.select(F.col("u").alias("v"), F.col("label").alias("other"))
        old = lists.join(vectors.select("u", "label"), "u").join(label, "v").where("label <> other")
        first = first.unionByName(old.select("u", "v", "cosine"))
    lists = stored(_best(first), "lists")
    entries, n = lists.count(), 0
    while entries:
        pairs = stored(_round(vectors, lists, 100 * seed + n), "pairs")
        links = links.unionByName(pairs.where("linked").select("u", "v"))
        listed = pairs.where("not linked").select("u", "v", "cosine")
        before, n = lists, n + 1
        lists = stored(_best(_both_ways(listed).unionByName(before)), "lists")
        release(vectors.sparkSession)
        if lists.join(before, ["u", "v"], "left_anti").count() <= CHANGED * entries:
            break
    return lists, stored(links.distinct(), "links")


def exhaustive(vectors: DataFrame) -> DataFrame:
    """u, v: a spanning forest of the links of every two blocks of a part; quadratic."""
    sizes = vectors.groupBy("part").agg(F.ceil(F.count("*") / ENLARGED).cast("int").alias("blocks"))
    dealt = vectors.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("u"), "blocks").cast("int"))
    # Every node goes to the pairs of its block with each block of the part.
    met = dealt.select("part", "u", "x", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    pair = met.select("part", "u", "x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, u = _matrix(frame["x"]), frame["u"].to_numpy()
        hits = x @ x.T >= THRESHOLD
        a, b = _spanning(hits | hits.T)
        return pd.DataFrame({"u": u[a], "v": u[b]})

    return stored(pair.groupBy("part", "i", "j").applyInPandas(run, "u long, v long"), "all-links")


def enlarge(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """u, n_links: links of each row of the members of the components (node, label), counted in blocks."""
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / ENLARGED).alias("blocks"))
    members = (
        labels.join(sizes, "label")
        .select(
            F.col("label"), F.col("node").alias("u"),
            F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
        )
        .join(vectors.select("u", "x", "weight"), "u")
    )
    members = stored(members.select("label", "block", "u", "x", "weight"), "members")

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(frame["x"])
        centre = x.mean(axis=0)
        norm = np.linalg.norm(centre)
        centre = centre / norm if norm > 0 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        return pd.DataFrame(
            {"label": frame["label"].iloc[:1], "block": frame["block"].iloc[:1], "centre": [centre.tobytes()],
             "radius": [radius], "size": [frame["weight"].sum()]}
        )

    balls = stored(
        members.groupBy("label", "block").applyInPandas(
            within, "label long, block long, centre binary, radius double, size long"
        ),
        "balls",
    )

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                dots = np.einsum("ij,ij->i", _padded(list(f["c1"])), _padded(list(f["c2"])))
                angle = np.arccos(np.clip(dots, -1, 1))
                spread, limit = f["r1"] + f["r2"], np.arccos(THRESHOLD)
                every = (angle + spread < limit - MARGIN).to_numpy()
                none = (angle - spread > limit + MARGIN).to_numpy()
                f = f.assign(kind=np.where(every, "all", np.where(none, "none", "compare")))
                yield f[["label", "block", "other", "size2", "kind"]]

    other = balls.select(
        "label", F.col("block").alias("other"), F.col("centre").alias("c2"), F.col("radius").alias("r2"),
        F.col("size").alias("size2"),
    )
    pairs = balls.join(other, "label").select(
        "label", "block", "other", F.col("centre").alias("c1"), "c2", F.col("radius").alias("r1"), "r2", "size2"
    )
    pairs = stored(
        pairs.mapInPandas(decide, "label long, block long, other long, size2 long, kind string"), "ball-pairs"
    )
    whole = pairs.where("kind = 'all'").groupBy("label", "block").agg(F.sum("size2").alias("n"))
    counted = members.join(whole, ["label", "block"]).select("u", "n")
    asked = pairs.where("kind = 'compare' and block <= other").select("label", "block", "other")
    left = members.join(asked, ["label", "block"]).select(
        "label", "block", "other", "u", "x", "weight", F.lit(0).alias("side")
    )
    right = members.withColumnRenamed("block", "other").join(
        asked.where("block < other"), ["label", "other"]
    ).select("label", "block", "other", "u", "x", "weight", F.lit(1).alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = frame[frame["side"] == 0], frame[frame["side"] == 1]
        x = _matrix(mine["x"])
        y = _matrix(theirs["x"]) if len(theirs) else x
        hits = (x @ y.T >= THRESHOLD).astype(np.float64)
        more = (theirs if len(theirs) else mine)["weight"].to_numpy()
        parts = [pd.DataFrame({"u": mine["u"], "n": (hits @ more).astype(np.int64)})]
        if len(theirs):
            parts.append(pd.DataFrame({"u": theirs["u"], "n": (mine["weight"].to_numpy() @ hits).astype(np.int64)}))
        return pd.concat(parts)

    compared = left.unionByName(right).groupBy("label", "block", "other").applyInPandas(compare, "u long, n long")
    # A row is counted once with itself.
    total = counted.unionByName(compared).groupBy("u").agg((F.sum("n") - 1).alias("n_links"))
    return stored(total, "counts")


def audit(vectors: DataFrame, counts: DataFrame, labels: DataFrame) -> float:
    """Mean share, over nodes with links, of the links of a node that counts has: the smaller one of
    large components and of all other nodes, estimated from a sample of each kind of node."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    size = labels.join(sizes, "label").select(F.col("node").alias("u"), "size")
    kind = F.when(F.col("size") > SMALL, "large").when(F.col("size").isNotNull(), "small").otherwise("alone")
    kinds = stored(
        vectors.select("u", "part", "x", "weight").join(size, "u", "left").join(counts, "u", "left")
        .select("u", "part", "x", "weight", kind.alias("kind"),
                F.coalesce("n_links", F.col("weight") - 1).alias("n_links")),
        "audit",
    )
    total = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    worst = 1.0
    seen: dict[str, tuple[float, float]] = {}
    for name, most in (("large", AUDIT), ("small", AUDIT_APART), ("alone", AUDIT_APART)):
        if name not in total:
            continue
        # A stated query set, at most ``most`` nodes, against all nodes of its label.
        asked = kinds.where(F.col("kind") == name).orderBy("u").limit(most)
        asked = asked.select("u", "part", "x", "n_links").toPandas()
        queries = {p: (f["u"].to_numpy(), _matrix(f["x"])) for p, f in asked.groupby("part")}

        def run(frames: Iterator[pd.DataFrame], queries=queries) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part, f in frame.groupby("part"):
                    if part in queries:
                        q, y = queries[part]
                        x, weight = _matrix(f["x"]), f["weight"].to_numpy()
                        n = ((y @ x.T >= THRESHOLD) @ weight.astype(np.float64)).astype(np.int64)
                        yield pd.DataFrame({"q": q[n > 0], "n": n[n > 0]})

        true = kinds.select("part", "x", "weight").mapInPandas(run, "q long, n long")
        true = true.groupBy("q").agg((F.sum("n") - 1).alias("n")).toPandas()
        both = asked.merge(true, left_on="u", right_on="q")
        both = both[both["n"] > 0]
        share = total[name] / len(asked)
        found = np.minimum(both["n_links"] / both["n"], 1.0).sum()
        seen[name] = (share * found, share * len(both))
    apart = [seen[k] for k in ("small", "alone") if k in seen]
    for found, linked in (seen.get("large", (0, 0)), (sum(f for f, _ in apart), sum(n for _, n in apart))):
        worst = min(worst, found / linked if linked else 1.0)
    return float(worst)


def _added(before: DataFrame, after: DataFrame) -> float:
    """Share of the nodes that have a component, outside those that were large, to which an attempt
    gave another component."""
    sizes = before.groupBy("label").agg(F.count("*").alias("size"))
    old = before.join(sizes, "label").select("node", F.col("label").alias("was"), "size")
    both = after.join(old, "node", "left").where(F.coalesce("size", F.lit(0)) <= SMALL)
    row = both.agg(F.count("*").alias("n"), F.count_if(~F.col("label").eqNullSafe(F.col("was"))).alias("new")).first()
    return row["new"] / row["n"] if row["n"] else 0.0


def near_duplicates(rows: DataFrame) -> tuple[DataFrame, float]:
    """One row per vector (vec_id, n_links, component_id, kept), and the audited recall."""
    every = _vectors(rows)
    nodes = _nodes(every)
    ends = "node long, label long"
    labels, lists, recall = rows.sparkSession.createDataFrame([], ends), None, 0.0
    links = None
    for attempt in range(ATTEMPTS):
        old = labels.select(F.col("node").alias("u"), "label")
        vectors = nodes.join(old, "u", "left").withColumn("label", F.coalesce("label", "u"))
        lists, found = descend(stored(vectors, "labelled"), lists, attempt + 1)
        links = found if links is None else links.unionByName(found)
        before, labels = labels, components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
        # Only when new projections add little is the rest worth an audit.
        if _added(before, labels) <= 1 - RECALL:
            counts = enlarge(nodes, labels)
            recall = audit(nodes, counts, labels)
            if recall >= RECALL:
                break
    else:
        links = exhaustive(nodes)
        labels = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
        counts, recall = enlarge(nodes, labels), 1.0
    named = labels.join(nodes.select(F.col("u").alias("node"), "least"), "node")
    least = named.groupBy("label").agg(F.min("least").alias("first"))
    group = labels.join(least, "label").select(F.col("node").alias("u"), "first")
    # Per distinct vector, then per row.
    settled = stored(
        nodes.join(counts, "u", "left").join(group, "u", "left").select(
            "u", "weight", F.coalesce("n_links", F.col("weight") - 1).alias("n_links"),
            F.coalesce("first", "least").alias("first"),
        ),
        "settled",
    )
    # The at most COMMON vectors that so many rows repeat are not dealt out by their name.
    common = F.broadcast(settled.where(F.col("weight") > max(1, every.count() // COMMON)).drop("weight"))
    own = every.select("u", "vec_id")
    usable = own.where("u is not null")
    joined = (
        usable.join(common, "u")
        .unionByName(usable.join(common.select("u"), "u", "left_anti").join(settled.drop("weight"), "u"))
        .unionByName(own.where("u is null").select("*", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("first")))
    )
    result = joined.select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)) | F.col("component_id").isNull()
    return result.withColumn("kept", kept), recall


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))[0]
