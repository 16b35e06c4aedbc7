"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are tokenized and end with id 0. Only those longer than a sequence are cut; full pieces
are sequences of their own. The rest are items to be packed. They are dealt at random into regions
of about ``REGION`` items, and each region is worked on by ``ISLANDS`` populations in tasks of
their own. Between epochs the best packing of each island moves to the next one of its region,
through a written table. What regions leave in their emptiest sequences is pooled over ``POOL``
regions at a time and packed anew in the same way, until one region is left.

A packing gives each item a group (its sequence). Crossover takes whole well-filled groups of one
parent into the other, drops the groups of the other that share items with them, and places the
displaced items by best fit, longest first. Mutation dissolves some of the emptiest groups.
Fewer groups are better, then fuller ones (mean of squared filling). A region stops early when its
number of groups is the smallest possible, total length over capacity.

Defined cases: null and empty texts are one token long (the id 0); rows that repeat a doc_id, also a
null one, are documents of their own; an empty table gives an empty result; further columns are
ignored. Equal input tables in equal files give equal packings; any packing is valid.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import body, stored, table
from stopwise.llm.words import default_path, words_of

CAPACITY = 2_048
REGION = 4_096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 8
POOL = 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


# --- pieces --------------------------------------------------------------------------------


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or default_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            rows = []
            found = words.each(text.as_py() for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids += b"\0\0\0\0"
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=PIECE_COLUMNS,
            )

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(pieces, PIECE)


# --- one population ------------------------------------------------------------------------


def best_fit(lengths: list[int], items: list[int], free: list[int], capacity: int) -> list[int]:
    """Place items (longest first) into the groups with the least room that is enough.

    ``free`` is the room of the groups and grows by new ones. Returns the group of each item.
    """
    open_groups = sorted((room, g) for g, room in enumerate(free) if room > 0)
    where = []
    for i in items:
        size = lengths[i]
        at = bisect.bisect_left(open_groups, (size, -1))
        if at < len(open_groups):
            room, g = open_groups.pop(at)
        else:
            room, g = capacity, len(free)
            free.append(capacity)
        free[g] = room - size
        if free[g] > 0:
            bisect.insort(open_groups, (free[g], g))
        where.append(g)
    return where


def fill(lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.bincount(group, weights=lengths).astype(np.int64)


def worth(lengths: np.ndarray, group: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of groups, then minus the mean of squared filling."""
    filled = fill(lengths, group)
    return len(filled), -float(np.mean((filled / capacity) ** 2))


def place(lengths: np.ndarray, group: np.ndarray, capacity: int) -> np.ndarray:
    """Complete a packing in which group -1 stands for items without one; numbers groups anew."""
    loose = np.flatnonzero(group < 0)
    kept = np.flatnonzero(group >= 0)
    out = np.full(len(group), -1, np.int64)
    n = 0
    if len(kept):
        names, out[kept] = np.unique(group[kept], return_inverse=True)
        n = len(names)
    free = (capacity - np.bincount(out[kept], weights=lengths[kept], minlength=n)).astype(int)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    out[order] = best_fit(lengths.tolist(), order.tolist(), free.tolist(), capacity)
    return out


def crossover(
    lengths: np.ndarray, into: np.ndarray, giver: np.ndarray, capacity: int, rng
) -> np.ndarray:
    """Inject a random half of the giver's well-filled groups into the other parent."""
    filled = fill(lengths, giver)
    good = np.flatnonzero(filled >= np.quantile(filled, 0.25))
    taken = rng.random(len(filled)) < 0.5
    chosen = np.zeros(len(filled), bool)
    chosen[good] = taken[good]
    injected = chosen[giver]
    # Groups of the other parent that hold an injected item are dropped with all they hold.
    hit = np.zeros(into.max() + 1, bool)
    hit[into[injected]] = True
    child = np.where(hit[into], -1, into)
    child[injected] = giver[injected] + len(hit)
    return place(lengths, child, capacity)


def mutate(lengths: np.ndarray, group: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Dissolve some of the emptiest groups and a few others."""
    filled = fill(lengths, group)
    n = len(filled)
    gone = np.argsort(filled, kind="stable")[: max(2, n // 50)]
    gone = np.concatenate([gone, rng.integers(0, n, max(1, n // 20))])
    return place(lengths, np.where(np.isin(group, gone), -1, group), capacity)


def evolve(
    lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng
) -> list[np.ndarray]:
    """The population after some generations, best first."""
    least = math.ceil(lengths.sum() / capacity)
    none = np.full(len(lengths), -1, np.int64)
    population = list(population)
    if not population:
        population.append(place(lengths, none, capacity))
    while len(population) < POPULATION:
        population.append(mutate(lengths, population[0], capacity, rng))
    ranked = sorted(((worth(lengths, p, capacity), i) for i, p in enumerate(population)))
    pool = [(w, population[i]) for w, i in ranked]
    for _ in range(generations):
        if pool[0][0][0] <= least:
            break
        a, b = sorted(rng.choice(len(pool), 2, replace=False))
        child = crossover(lengths, pool[b][1], pool[a][1], capacity, rng)
        if rng.random() < 0.5:
            child = mutate(lengths, child, capacity, rng)
        found = worth(lengths, child, capacity)
        if found < pool[-1][0]:
            pool[-1] = (found, child)
            pool.sort(key=lambda x: x[0])
    return [p for _, p in pool[:POPULATION]]


# --- islands on Spark ----------------------------------------------------------------------

STATE = "region long, island int, rows binary, lengths binary, population array<binary>"


def _epoch(islands: DataFrame, capacity: int, generations: int, epoch: int) -> DataFrame:
    """Let every island evolve once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            after = []
            for r in frame.itertuples(index=False):
                rng = np.random.default_rng([r.region, r.island, epoch, len(r.rows)])
                lengths = np.frombuffer(r.lengths, "<i4").astype(np.int64)
                before = [np.frombuffer(p, "<i4").astype(np.int64) for p in r.population]
                found = evolve(lengths, before, capacity, generations, rng)
                after.append([p.astype("<i4").tobytes() for p in found])
            yield frame.assign(population=after)

    return islands.mapInPandas(run, STATE)


def pack_regions(
    items: DataFrame,
    regions: int,
    capacity: int = CAPACITY,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
) -> DataFrame:
    """Pack items (row, length) in random regions: row, length, region, bin."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        return pd.DataFrame(
            {
                "region": [frame["region"].iloc[0]],
                "rows": [frame["row"].to_numpy("<i8").tobytes()],
                "lengths": [frame["length"].to_numpy("<i4").tobytes()],
            }
        )

    region = F.pmod(F.xxhash64("row", F.lit(regions)), F.lit(regions))
    dealt = items.select("row", "length", region.alias("region"))
    state = (
        dealt.groupBy("region")
        .applyInPandas(gather, "region long, rows binary, lengths binary")
        .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        .withColumn("population", F.array().cast("array<binary>"))
        .select("region", "island", "rows", "lengths", "population")
    )
    state = state.repartition("region", "island")
    for epoch in range(epochs):
        state = stored(_epoch(state, capacity, generations, epoch), "islands")
        if epoch + 1 < epochs:
            # The elite of each island joins the next one of its region.
            elite = state.select(
                "region",
                F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                F.slice("population", 1, 1).alias("elite"),
            )
            state = state.join(elite, ["region", "island"]).select(
                "region", "island", "rows", "lengths",
                F.concat("elite", "population").alias("population"),
            )

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(frame["rows"].iloc[0], "<i8")
        lengths = np.frombuffer(frame["lengths"].iloc[0], "<i4").astype(np.int64)
        found = [np.frombuffer(p[0], "<i4").astype(np.int64) for p in frame["population"]]
        best = min(found, key=lambda p: worth(lengths, p, capacity))
        return pd.DataFrame(
            {"row": rows, "length": lengths, "region": frame["region"].iloc[0], "bin": best}
        )

    return state.groupBy("region").applyInPandas(
        settle, "row long, length long, region long, bin long"
    )


def _loose(packed: DataFrame, capacity: int, share: int) -> DataFrame:
    """The emptiest groups of each region that hold at most ``share`` items together, marked."""

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame["bin"].to_numpy()
        filled = fill(frame["length"].to_numpy(), group)
        sizes = np.bincount(group)
        order = np.argsort(filled, kind="stable")
        loose = order[np.cumsum(sizes[order]) <= share]
        loose = loose[filled[loose] < capacity]
        return frame.assign(loose=np.isin(group, loose))

    return packed.groupBy("region").applyInPandas(
        mark, "row long, length long, region long, bin long, loose boolean"
    )


def pack_items(items: DataFrame, capacity: int = CAPACITY, region: int = REGION) -> DataFrame:
    """Pack items (row, length): row, length, sequence (unique numbers), level by level."""
    regions, level, done = max(1, math.ceil(items.count() / region)), 0, None
    while True:
        packed = pack_regions(items, regions, capacity)
        last = regions == 1
        if not last:
            packed = _loose(packed, capacity, region // POOL)
        packed = stored(packed, "packed")
        number = F.lit(level << 56) + F.col("region") * F.lit(1 << 24) + F.col("bin")
        settled = packed.where("true" if last else "not loose").select(
            "row", "length", number.alias("sequence_id")
        )
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        items = packed.where("loose").select("row", "length")
        regions, level = math.ceil(regions / POOL), level + 1


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece, with the sequence it is in and its place there."""
    # Written once: row numbers follow the files and stay.
    pieces = stored(cut(docs, capacity, path), "pieces")
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "numbered")
    full = pieces.where(F.col("length") == capacity).select(
        *PIECE_COLUMNS, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    items = pieces.where(F.col("length") < capacity)
    packed = stored(pack_items(items.select("row", "length"), capacity), "sequences")
    # A sequence holds at most ``capacity`` items.
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("length"), "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = packed.select(
        "row",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )
    return full.unionByName(items.join(placed, "row").select(*full.columns))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
