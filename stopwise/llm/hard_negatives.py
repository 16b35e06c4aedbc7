"""Hard negatives by a cover tree over norm-augmented candidates.

Vectors are whole numbers (``floor(SCALE * x)``) and scores their inner products, so every score is
exact. A candidate of squared norm s gets one more component, sqrt(M - s), with M the largest squared
norm: all candidates then lie on one sphere, a query (with a zero there) keeps its inner products, and
near means a great inner product. The tree covers that sphere:

* Its upper levels are made by Spark. A node with more than ``LEAF`` candidates takes up to ``FAN``
  centres, far apart from each other, from a sample of ``SAMPLE`` of its candidates, and every candidate
  goes to the nearest one; this repeats until all nodes are small. Radii are measured over all
  candidates, so the sample decides only how well the tree prunes, never what is found.
* Below that, a task builds the levels of one such block in the same way, down to ``BUCKET`` candidates.

A node with centre c and covering radius r holds inner products with q between q.c - e and q.c + e,
where e is |q| r or, by the sphere, less. A search asks for the best ``k`` within a window of scores. It
visits the ``FIRST`` blocks with the best bounds, and then only blocks whose bound reaches the k-th
score found there. In a block the descent is best first: leaves come in the order of the best bounds that
they and the nodes above them have, those outside the windows are skipped, it ends when the next bound
is below the k-th score, and leaves are verified by exact products. Bounds are compared in blocks of
queries and blocks of nodes. A block that many queries visit is dealt out with them.

Equal vectors of one label are one candidate that keeps its ``k`` + 1 smallest ids: no search can
return more of them. Anchors that are equal vectors of one label are one query.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part,
nor do rows whose squared norm reaches 2**62 (scores are 64-bit numbers); an empty vector has score 0
with all; of vectors of different lengths the shorter one counts as ended by zeros; rows that repeat
a vec_id are rows of their own, and an anchor is only kept apart from its own row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import release, stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these percentages of the positive's.
WINDOW = (30, 90)
LEAF, FAN, SAMPLE = 8_192, 16, 512
BUCKET, BRANCHES = 128, 8
FIRST = 2
#: Queries and nodes that are compared at a time, and queries that share a copy of a block.
CHUNK = 1_024
#: Levels of the upper tree; what they leave large is dealt out by hash.
LEVELS = 24
MOST = 2.0**62


def candidates(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The usable rows (vec_id, u), and the distinct ones (u, label, x, norm, ids): ``u`` names label and
    vector, ``ids`` are the ``keep`` smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if vec_id is None or label is None or v is None or any(e is None for e in v):
                    continue
                x = np.floor(SCALE * np.array(v, np.float64))
                norm = float(x @ x)
                if not norm < MOST:
                    continue
                # Zeros at the end change no product.
                whole = np.trim_zeros(x.astype(np.int64), "b")
                out.append((vec_id, label, whole.tobytes(), norm))
            if out:
                columns = zip(*out, strict=True)
                types = [pa.int64(), pa.string(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["vec_id", "label", "x", "norm"]
                )

    usable = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    usable = usable.mapInArrow(run, "vec_id long, label string, x binary, norm double")
    name = F.unhex(F.md5(F.concat("x", F.col("label").cast("binary"), F.octet_length("x").cast("string").cast("binary"))))
    usable = stored(usable.withColumn("u", name), "vectors")
    nth = F.row_number().over(Window.partitionBy("u").orderBy("vec_id"))
    least = usable.withColumn("nth", nth).where(F.col("nth") <= keep)
    distinct = least.groupBy("u").agg(
        F.first("label").alias("label"), F.first("x").alias("x"), F.first("norm").alias("norm"),
        F.sort_array(F.collect_list("vec_id")).alias("ids"),
    )
    return usable.select("vec_id", "u"), stored(distinct, "candidates")


def _matrix(x: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows of whole numbers, ended by zeros."""
    width = max([width, *(len(v) // 8 for v in x)])
    return np.frombuffer(b"".join([v.ljust(8 * width, b"\0") for v in x]), np.int64).reshape(len(x), width)


def _augmented(x: list[bytes], norm, most: float, width: int) -> np.ndarray:
    """Vectors on the sphere; the added component comes first, since lengths may differ."""
    own = np.sqrt(np.maximum(most - np.asarray(norm, np.float64), 0.0))
    return np.column_stack([own, _matrix(x, width)])


def far_apart(x: np.ndarray, most: int) -> np.ndarray:
    """Rows that are far apart from each other: each is the farthest from all before it."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its distance."""
    squared = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
    at = squared.argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


def _streams(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[dict], Iterator[list[dict]]]]:
    """Per group of sorted rows (``keys`` columns, then ``kind``) its rows of kind 0, and those of kind 1
    in pieces. Only the former are held."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield values[:keys], dict(zip(names, values, strict=True))

    stream = rows()
    ahead = next(stream, None)
    while ahead:
        key, few = ahead[0], []
        while ahead and ahead[0] == key and ahead[1]["kind"] == 0:
            few.append(ahead[1])
            ahead = next(stream, None)

        def many() -> Iterator[list[dict]]:
            nonlocal ahead
            while ahead and ahead[0] == key:
                piece = []
                while ahead and ahead[0] == key and len(piece) < CHUNK:
                    piece.append(ahead[1])
                    ahead = next(stream, None)
                yield piece

        yield few, many()


def _beside(few: DataFrame, many: DataFrame, run: Callable, schema: str, size: int = CHUNK) -> DataFrame:
    """Rows of ``many`` go through ``run`` with the rows of ``few`` of the same block beside them.

    A block with over ``size`` rows of ``many`` is dealt out, and each part gets a copy of its few.
    """
    parts = many.groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    parts = stored(parts, "parts")
    every = few.join(parts, "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = many.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("u"), "parts").cast("int"))
    rows = every.withColumn("kind", F.lit(0)).unionByName(dealt.withColumn("kind", F.lit(1)), True).drop("parts")
    keys = ["block", "part", "kind"]
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return rows.repartition("block", "part").sortWithinPartitions(*keys).mapInArrow(run, schema)


def _split(members: DataFrame, most: float, width: int) -> DataFrame:
    """u, block, distance: the next level of blocks of the members (u, x, norm, block)."""
    order = Window.partitionBy("block").orderBy(F.xxhash64("u", "block"), "u")
    sample = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)

    def centres(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("u")
        own = far_apart(_augmented(list(frame["x"]), frame["norm"], most, width), FAN)
        return frame.iloc[own].assign(centre=np.arange(len(own)))[["block", "centre", "x", "norm"]]

    chosen = sample.select("block", "u", "x", "norm").groupBy("block").applyInPandas(
        centres, "block string, centre int, x binary, norm double"
    )
    chosen = stored(chosen, "centres")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, pieces in _streams(batches, 2):
            few.sort(key=lambda c: c["centre"])
            middle = _augmented([c["x"] for c in few], [c["norm"] for c in few], most, width)
            for piece in pieces:
                x = _augmented([c["x"] for c in piece], [c["norm"] for c in piece], most, width)
                at, distance = nearest(x, middle)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["u"] for c in piece], pa.binary()),
                        pa.array([f"{piece[0]['block']}/{i}" for i in at], pa.string()),
                        pa.array([few[i]["x"] for i in at], pa.binary()),
                        pa.array([few[i]["norm"] for i in at], pa.float64()),
                        pa.array(distance),
                    ],
                    ["u", "block", "centre", "centre_norm", "distance"],
                )

    schema = "u binary, block string, centre binary, centre_norm double, distance double"
    return _beside(chosen, members.select("u", "x", "norm", "block"), run, schema, 4 * CHUNK)


class Tree:
    """The candidates with the block of each, and the blocks with centre and covering radius."""

    def __init__(self, distinct: DataFrame):
        top = distinct.agg(F.max("norm"), F.max(F.octet_length("x"))).first()
        self.most, self.width = top[0] or 0.0, (top[1] or 0) // 8
        placed = distinct.select("u", F.lit("").alias("block"), F.lit(None).cast("binary").alias("centre"),
                                 F.lit(0.0).alias("centre_norm"), F.lit(math.inf).alias("distance"))
        small = []
        for level in range(LEVELS):
            sizes = placed.groupBy("block").agg(F.count("*").alias("n"))
            sized = stored(placed.join(sizes, "block"), "level")
            small.append(sized.where(F.col("n") <= LEAF).drop("n"))
            large = sized.where(F.col("n") > LEAF)
            if large.isEmpty():
                break
            members = large.select("u", "block").join(distinct.select("u", "x", "norm"), "u")
            if level < LEVELS - 1:
                placed = stored(_split(members, self.most, self.width), "placed")
            else:
                # Equal vectors of many labels are not told apart by centres.
                deal = F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / LEAF)).cast("string")
                small.append(large.withColumn("block", F.concat_ws("=", "block", deal)).drop("n"))
        every = small[0]
        for other in small[1:]:
            every = every.unionByName(other)
        self.rows = stored(distinct.join(every.select("u", "block"), "u"), "placed-candidates")
        self.blocks = stored(
            every.groupBy("block").agg(
                F.first("centre").alias("centre"), F.first("centre_norm").alias("centre_norm"),
                F.max("distance").alias("radius"),
            ),
            "blocks",
        )


def spread(dot: np.ndarray, q_norm: np.ndarray, radius: np.ndarray, most: float) -> np.ndarray:
    """How far inner products within ``radius`` of a centre may be from the centre's, per query and node.

    Rounding is allowed for.
    """
    d = np.sqrt(np.maximum(q_norm[:, None] + most - 2 * dot, 0.0))
    with np.errstate(invalid="ignore"):
        sphere = np.where(np.isfinite(radius) & (d > radius), d * radius - radius**2 / 2, np.inf)
        e = np.minimum(np.sqrt(q_norm)[:, None] * radius, sphere)
    return np.where(np.isfinite(radius), e, np.inf) + 1e-9 * (np.sqrt(q_norm)[:, None] * math.sqrt(most) + 1)


def bounds(q: np.ndarray, q_norm, centres: np.ndarray, radius, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries (rows) with what nodes (columns) hold."""
    dot = q @ centres.T
    above = spread(dot, np.asarray(q_norm), np.asarray(radius), most)
    # Below the centre the sphere bends the other way: only the plain bound holds there.
    plain = np.sqrt(np.asarray(q_norm))[:, None] * np.where(np.isfinite(radius), radius, 0)
    low = np.where(np.isfinite(radius), dot - plain, -np.inf) - 1e-9 * (np.sqrt(q_norm)[:, None] * math.sqrt(most) + 1)
    return low, dot + above


class Block:
    """The lower levels of the tree over the candidates of one block."""

    def __init__(self, few: list[dict], most: float, width: int):
        self.most = most
        self.code = {label: i for i, label in enumerate({c["label"] for c in few})}
        self.label = np.array([self.code[c["label"]] for c in few])
        self.ids = [c["ids"] for c in few]
        whole = _matrix([c["x"] for c in few], width)
        # Products below 2**53 are exact in doubles.
        self.x = whole.astype(np.float64) if most < 2.0**52 else whole
        on_sphere = np.column_stack([np.sqrt(np.maximum(most - np.array([c["norm"] for c in few]), 0.0)), whole])
        self.centre, self.radius, self.parent, self.own = [], [], [], []
        self._grow(np.arange(len(few)), len(few) // 2, -1, on_sphere, 0)
        # Without the added component: the query has a zero there.
        self.centres = whole[self.centre].astype(np.float64)
        self.radii = np.array(self.radius)
        self.leaves = np.array([i for i, rows in enumerate(self.own) if rows is not None])

    def _grow(self, rows: np.ndarray, centre: int, parent: int, x: np.ndarray, depth: int) -> None:
        node = len(self.centre)
        distance = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.parent.append(parent)
        self.own.append(None)
        if len(rows) <= BUCKET or self.radius[node] == 0 or depth > 40:
            self.own[node] = rows
            return
        own = rows[far_apart(x[rows], BRANCHES)]
        at, _ = nearest(x[rows], x[own])
        for i in range(len(own)):
            if (at == i).any():
                self._grow(rows[at == i], int(own[i]), node, x, depth + 1)

    def leaf_bounds(self, q: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of every query (row) for every leaf, none wider than those of the nodes above it, and
        the leaves in the order in which a descent by the best bound comes to them."""
        low, high = bounds(q, norms, self.centres, self.radii, self.most)
        # Nodes come after their parents.
        for node, parent in enumerate(self.parent):
            if parent >= 0:
                np.maximum(low[:, node], low[:, parent], out=low[:, node])
                np.minimum(high[:, node], high[:, parent], out=high[:, node])
        low, high = low[:, self.leaves], high[:, self.leaves]
        return low, high, np.argsort(-high, axis=1, kind="stable")

    def search(self, q: np.ndarray, low, high, order, label: str, same: bool, windows: list[tuple], k: int) -> list:
        """The best k of (-score, id) within each window (least, greatest).

        One descent serves all windows of a query. It takes ever more leaves at a time.
        """
        found: list[list[tuple]] = [[] for _ in windows]
        floor, top = [least for least, _ in windows], max(greatest for _, greatest in windows)
        own, at, step = self.code.get(label, -1), 0, 2
        while at < len(order):
            need = min(floor)
            if high[order[at]] < need:
                break
            visited = [self.own[self.leaves[i]] for i in order[at : at + step] if high[i] >= need and low[i] <= top]
            at, step = at + step, 2 * step
            if not visited:
                continue
            rows = np.concatenate(visited)
            score = self.x[rows] @ q
            fits = np.flatnonzero(((self.label[rows] == own) == same) & (score >= need) & (score <= top))
            fits = fits[np.argsort(-score[fits], kind="stable")]
            score, rows = score[fits], rows[fits]
            for j, (_, greatest) in enumerate(windows):
                new: list[tuple] = []
                for i in range(int(np.searchsorted(-score, -greatest)), len(score)):
                    # Equal scores stay, their ids decide.
                    if score[i] < floor[j] or (len(new) >= k and -score[i] > new[-1][0]):
                        break
                    new += [(-int(score[i]), vec_id) for vec_id in self.ids[rows[i]][:k]]
                if new:
                    found[j] = sorted(found[j] + new)[:k]
                    if len(found[j]) == k:
                        floor[j] = max(floor[j], -found[j][-1][0])
        return found


_WINDOWS = "array<struct<w:int,least:double,greatest:double,reached:double>>"


def _promising(tree: Tree, queries: DataFrame, first: int | None) -> DataFrame:
    """u, w, block, bound: the blocks that may hold scores of a window above what it has ``reached``,
    or of those the ``first`` ones with the best bounds."""
    n_queries, n_blocks = queries.count(), tree.blocks.count()
    batches, chunks = max(1, math.ceil(n_queries / CHUNK)), max(1, math.ceil(n_blocks / CHUNK))
    most, width = tree.most, tree.width

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, pieces in _streams(stream, 2):
            if not few:
                for _ in pieces:
                    pass
                continue
            centres = _matrix([c["centre"] or b"" for c in few], width).astype(np.float64)
            radius = np.array([c["radius"] for c in few])
            names = [c["block"] for c in few]
            for piece in pieces:
                q = _matrix([c["x"] for c in piece], width).astype(np.float64)
                lows, highs = bounds(q, np.array([c["norm"] for c in piece]), centres, radius, most)
                out = []
                for c, low, high in zip(piece, lows, highs, strict=True):
                    for window in c["windows"]:
                        fits = (low <= window["greatest"]) & (high >= max(window["least"], window["reached"]))
                        at = np.flatnonzero(fits)
                        if first is not None and len(at) > first:
                            at = at[np.argsort(-high[at], kind="stable")[:first]]
                        out += [(c["u"], window["w"], names[i], high[i]) for i in at]
                columns = list(zip(*out, strict=True)) or [()] * 4
                types = [pa.binary(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["u", "w", "block", "bound"]
                )

    # Every batch of queries meets every chunk of blocks.
    few = tree.blocks.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))
    few = few.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("kind", F.lit(0))
    many = queries.withColumn("batch", F.pmod(F.xxhash64("u"), F.lit(batches)).cast("int"))
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("kind", F.lit(1))
    rows = few.unionByName(many, True)
    keys = ["batch", "chunk", "kind"]
    rows = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    met = rows.repartition("batch", "chunk").sortWithinPartitions(*keys).mapInArrow(
        run, "u binary, w int, block string, bound double"
    )
    if first is not None:
        order = Window.partitionBy("u", "w").orderBy(F.desc("bound"), "block")
        met = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first).drop("nth")
    return stored(met.drop("bound"), "promising")


def _visit(tree: Tree, queries: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
    """u, w, score, vec_id: the best k of each window in each block of the pairs (u, w, block)."""
    most, width = tree.most, tree.width
    windows = queries.select("u", F.explode("windows").alias("window")).select("u", "window.w", "window")
    asked = pairs.join(windows, ["u", "w"]).groupBy("u", "block").agg(F.collect_list("window").alias("windows"))
    asked = asked.join(queries.select("u", "label", "x", "norm"), "u")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, pieces in _streams(stream, 2):
            block = Block(few, most, width)
            for piece in pieces:
                q = _matrix([c["x"] for c in piece], width)
                norms = np.array([c["norm"] for c in piece])
                bounded = zip(*block.leaf_bounds(q.astype(np.float64), norms), strict=True)
                exact = q.astype(block.x.dtype)
                out = []
                for x, c, (low, high, order) in zip(exact, piece, bounded, strict=True):
                    windows = [(max(w["least"], w["reached"]), w["greatest"]) for w in c["windows"]]
                    best = block.search(x, low, high, order, c["label"], same, windows, k)
                    for w, found in zip(c["windows"], best, strict=True):
                        out += [(c["u"], w["w"], -score, vec_id) for score, vec_id in found]
                columns = list(zip(*out, strict=True)) or [()] * 4
                types = [pa.binary(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["u", "w", "score", "vec_id"]
                )

    rows = tree.rows.select("block", "label", "x", "norm", "ids")
    schema = "u binary, w int, score long, vec_id long"
    return stored(_beside(rows, asked, run, schema), "found")


def _best(found: DataFrame, k: int) -> DataFrame:
    """u, w, nth, score, vec_id: the first k of each window."""
    order = Window.partitionBy("u", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def search(tree: Tree, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """u, w, nth, score, vec_id: of each query (u, label, x, norm, windows of w, least, greatest) and window
    the k candidates of the same or of another label with the greatest scores."""
    open_ = F.transform("windows", lambda w: F.struct(
        w["w"].alias("w"), w["least"].alias("least"), w["greatest"].alias("greatest"),
        F.lit(-math.inf).alias("reached")))
    queries = stored(queries.withColumn("windows", open_.cast(_WINDOWS)), "queries")
    seen = _promising(tree, queries, FIRST)
    found = _visit(tree, queries, seen, same, k)
    reached = _best(found, k).where(F.col("nth") == k).select("u", "w", F.col("score").cast("double").alias("score"))
    reached = reached.groupBy("u").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("scores"))
    raised = F.transform("windows", lambda w: F.struct(
        w["w"].alias("w"), w["least"].alias("least"), w["greatest"].alias("greatest"),
        F.coalesce(F.element_at("scores", w["w"]), F.lit(-math.inf)).alias("reached")))
    narrowed = queries.join(reached, "u", "left").withColumn("windows", raised.cast(_WINDOWS)).drop("scores")
    narrowed = stored(narrowed, "narrowed")
    rest = _promising(tree, narrowed, None).join(seen, ["u", "w", "block"], "left_anti")
    found = found.unionByName(_visit(tree, narrowed, rest, same, k))
    release(queries.sparkSession)
    return stored(_best(found, k), "best")


def hard_negatives(rows: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id,
    label, embedding) of which ``anchor``, a condition on vec_id, holds."""
    usable, distinct = candidates(rows, max(POSITIVES, NEGATIVES) + 1)
    tree = Tree(distinct)
    anchors = stored(usable.where(anchor), "anchors")
    asked = distinct.join(anchors.select("u").distinct(), "u").select("u", "label", "x", "norm")

    def window(w: Column, least: Column, greatest: Column) -> Column:
        return F.struct(w.cast("int").alias("w"), least.cast("double").alias("least"),
                        greatest.cast("double").alias("greatest"))

    everything = F.array(window(F.lit(0), F.lit(-math.inf), F.lit(math.inf)))
    near = search(tree, asked.withColumn("windows", everything), True, POSITIVES + 1)
    near = near.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("nth", "score", "vec_id"))).alias("near"))
    near = stored(near, "positives")
    # Each anchor without its own row.
    own = F.array_position(F.transform("near", lambda p: p["vec_id"]), F.col("vec_id")).cast("int")
    n = F.size("near")
    others = F.when(own == 0, F.col("near")).otherwise(
        F.concat(F.slice("near", F.lit(1), own - 1), F.slice("near", own + 1, F.greatest(n - own, F.lit(0))))
    )
    pairs = anchors.join(near, "u").select("u", F.col("vec_id").alias("anchor_id"), F.slice(others, 1, POSITIVES).alias("p"))
    pairs = pairs.select("u", "anchor_id", F.explode("p").alias("p")).select(
        "u", "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score")
    )
    # Windows of scores: whole numbers between the two percentages.
    low, high = WINDOW
    scores = near.select("u", F.explode(F.array_distinct(F.transform("near", lambda p: p["score"]))).alias("positive_score"))
    # Hundreds apart from the rest, since a multiple of a large score exceeds a long.
    hundred, rest = F.expr("positive_score div 100"), F.expr("positive_score % 100")
    least = hundred * low + F.ceil(rest * low / 100)
    greatest = hundred * high + F.floor(rest * high / 100)
    # The window of a negative score is empty.
    nth = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("positive_score")))
    scores = scores.where("positive_score >= 0").withColumn("w", nth)
    scores = stored(scores.withColumn("least", least).withColumn("greatest", greatest), "windows")
    windows = scores.groupBy("u").agg(F.collect_list(window(F.col("w"), F.col("least"), F.col("greatest"))).alias("windows"))
    far = search(tree, asked.join(windows, "u"), False, NEGATIVES)
    far = far.join(scores.select("u", "w", "positive_score"), ["u", "w"]).select(
        "u", "positive_score", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    return pairs.join(far, ["u", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
