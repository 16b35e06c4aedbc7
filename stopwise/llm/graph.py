"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.llm.common import discard, release, stored

#: Edges that a task joins by itself.
EDGES = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), ascending, and the smallest node that each can reach by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _forests(edges: DataFrame, parts: int) -> DataFrame:
    """node, label: the smallest node that a node can reach by the edges of its part, in each part."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            found = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "label"])

    dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts)
    return dealt.mapInArrow(join, "node long, label long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that can be reached) for every node of edges (a, b).

    Tasks join ``EDGES`` edges each and leave one edge per node at most. If that took several tasks,
    rounds over the rest follow: each hands every node the smallest label among its neighbours, then
    follows labels to the label of the label, so chains shrink by halves. Rounds are written tables;
    the groupings keep one number per node and are reduced before they are shuffled.
    """
    edges = stored(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    release(edges.sparkSession)
    parts = max(1, math.ceil(edges.count() / EDGES))
    labels = stored(_forests(edges, parts), "labels")
    discard(edges)
    return labels if parts == 1 else _rounds(labels)


def _rounds(stars: DataFrame) -> DataFrame:
    """The labels of all parts' nodes, where a node is in several parts."""
    both = stars.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    discard(stars)
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(
            step.join(jump, "label").select(
                "node", "before", F.least("label", "further").alias("label")
            ),
            "labels",
        )
        discard(labels)
        labels = after.select("node", "label")
        labels.stored_at = after.stored_at
        if after.where("before <> label").isEmpty():
            discard(both)
            return labels
