"""N-gram Jaccard join of documents by PartEnum signatures.

A document is the set of its word shingles. Sizes are cut into bands such that sets of similarity
``NUM`` / ``DEN`` or more lie in the same band or in neighbours; instance j of the join covers band
j and the one below. Inside an instance such sets differ in at most k_j elements, so when the
feature domain is cut into more than k_j partitions, the sets agree on one partition at least: they
share the signature that hashes (instance, partition, elements there).

Two refinements keep signatures few. Small sets have k + 1 partitions, and the agreeing one may be
empty; empty partitions have no signature, so the domain is cut anew under further seeds until
there are ``SIGNATURES`` partitions (``SEEDS`` cuts at most). Sets of more than ``SIGNATURES``
differences have ``COARSE`` * (k + 1) partitions and enumerate ``SIGNATURES`` of them. Each of
these agrees for a linked pair with a probability of 0.36 or more, as the differences fall at
random: all differ with a probability below 0.64^40 < 2e-8 for a link at the threshold.

Texts with equal sets are one node, and only different sets are compared.

1. Every signature of several nodes names a hub, and nodes are compared with the hubs that they
   share two signatures with. Verified links give components. This is done ``HUBS`` times with other
   hubs; most signatures then hold one component only.
2. Nodes of the other signatures are held against how many of their nodes have each shingle. A linked
   set has ``NUM`` / ``DEN`` of its shingles in common with one of another component: nodes with
   fewer that occur in another component have no link, and two linked sets share the rarest of what
   they have in common, which in either is among the few rarest of all (``_rarest``). Nodes that are
   connected by those shingles are a family. Within a family every two nodes of different components
   and fitting sizes are compared, in blocks of ``BLOCK`` nodes per side, by products of sparse
   columns; only links leave a block. Blocks of one component are skipped. A block's texts go to each
   of its pairs; many pairs of a large family are dealt out in turns, so that the disk holds ``TIMES``
   the texts of all families at most.

So no group is expanded into rows of pairs, and no link between components is left out. Every
comparison is exact, on the shingles of the whole texts.

Defined cases: null and texts without words have size 0 and link with nothing; fewer words than a
shingle are one shingle; a null doc_id takes part and is no component_id unless a component has no
other; rows that repeat a doc_id are documents of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import body, discard, release, stored, table
from stopwise.llm.graph import components
from stopwise.llm.shingles import STEP, mix, shingles

#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
SIGNATURES = 40
COARSE = 0.8
SEEDS = 8
HUBS = 2
#: A turn before those with the hubs of one in so many signatures.
FEW = 8
#: Nodes on either side of a block of comparisons, and about how many shingles these have together.
BLOCK = 256
BLOCK_SHINGLES = 150_000
#: Texts of pairs of blocks that are dealt out in one turn: times the texts of all families, and
#: shingles that are few in any case.
TIMES = 8
FEW_SHINGLES = 20_000_000

#: Shingles of a row, and of rows that leave a task together, where shingles are rows' columns.
ROW = 2_000
ROWS = 500_000

#: Shingles of sets that a task remembers.
REMEMBERED = 4_000_000

#: Stands for a null doc_id in joins; texts found by it are told apart by their digests.
NO_ID = -(2**63)


def bands(up_to: int) -> list[tuple[int, int]]:
    """Smallest and largest size of each band, as far as ``up_to``."""
    found, low = [], 1
    while low <= up_to:
        high = low * DEN // NUM
        found.append((low, high))
        low = high + 1
    return found


_bands = bands(1 << 40)
_starts = np.array([low for low, _ in _bands])


def most_differences(instance: int) -> int:
    """Elements in which linked sets of the instance differ at most.

    Of sizes r and s, the intersection is at least NUM / (NUM + DEN) * (r + s).
    """
    return 2 * _bands[instance][1] * (DEN - NUM) // (DEN + NUM)


SEED = np.array([(i + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF for i in range(SEEDS)], np.uint64)


def partitions(instance: int, enough: int = SIGNATURES, coarse: float = COARSE) -> int:
    least = most_differences(instance) + 1
    return least if least <= enough * coarse else max(int(enough * coarse), math.ceil(coarse * least))


def signatures(found: np.ndarray, enough: int = SIGNATURES, coarse: float = COARSE) -> np.ndarray:
    """The signatures of a set of hashes."""
    if not len(found):
        return found
    band = int(np.searchsorted(_starts, len(found), "right")) - 1
    out = []
    for instance in (band, band + 1):
        parts = partitions(instance, enough, coarse)
        seeds = SEED[: -(-enough // parts)]
        dealt = mix(found + seeds[:, None])
        part = ((dealt >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        part += np.arange(len(seeds), dtype=np.uint64)[:, None] << np.uint64(32)
        part, dealt = part.ravel(), dealt.ravel()
        if parts > enough:
            few = part < enough
            part, dealt = part[few], dealt[few]
            if not len(part):
                continue
        order = np.argsort(part, kind="stable")
        part, dealt = part[order], mix(dealt[order])
        first = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        sums = np.add.reduceat(dealt, first)
        sizes = np.diff(np.append(first, len(part))).astype(np.uint64)
        name = np.uint64(instance << 40) + part[first]
        out.append(mix(mix(sums + sizes) + mix(name * STEP + np.uint64(1))))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, id (never null), n_shingles, digest, key (64 bits of it), signatures, digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys, signs, texts = [], [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                texts.append(xxhash.xxh3_128_digest(text.as_py().encode()))
                sizes.append(len(found))
                digests.append(_digest(found))
                keys.append(int.from_bytes(digests[-1][:8], "little", signed=True))
                signs.append(signatures(found).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.int64()),
                    pa.array(signs, pa.list_(pa.int64())),
                    pa.array(texts, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "key", "signs", "text_digest"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), body().alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, key long, signs array<long>, text_digest binary"
    return rows.mapInArrow(run, schema).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, packed: the compressed text of each node (node, id, text_digest)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.as_py().encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary())], names=["id", "packed"]
            )

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            packed, digests = batch.column(1), batch.column(2)
            fits = [
                xxhash.xxh3_128_digest(unpacker.decompress(p.as_py())) == d.as_py()
                for p, d in zip(packed, digests, strict=True)
            ]
            yield batch.select(["node", "packed"]).filter(pa.array(fits, pa.bool_()))

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), body().alias("text"))
    found = rows.mapInArrow(pack, "id long, packed binary").join(nodes, "id")
    found = found.select("node", "packed", "text_digest").mapInArrow(right, "node long, packed binary")
    # Rows that repeat an id with its text.
    return found.dropDuplicates(["node"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}
        held = 0

        def set_of(node: int, packed: pa.Scalar) -> np.ndarray:
            nonlocal held
            if node not in sets:
                if held > REMEMBERED:
                    sets.clear()
                    held = 0
                sets[node] = shingles(unpacker.decompress(packed.as_py()).decode())
                held += len(sets[node])
            return sets[node]

        for batch in batches:
            fits = []
            for a, b, mine, theirs in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3),
                strict=True,
            ):
                hub, other = set_of(a, mine), set_of(b, theirs)
                both = len(np.intersect1d(hub, other, assume_unique=True))
                fits.append(DEN * both >= NUM * (len(hub) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    members = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("theirs")), "b")
    hubs = texts.select(F.col("node").alias("a"), F.col("packed").alias("mine"))
    both = members.join(hubs, "a").select("a", "b", "mine", "theirs")
    return both.mapInArrow(check, "a long, b long")


def _stars(spread: DataFrame) -> DataFrame:
    """Edges (a, b) from the smallest of each signature's labels (sign, a) to its others."""
    least = spread.groupBy("sign").agg(F.min("a").alias("least"), F.max("a").alias("most"))
    least = least.where("least < most").select("sign", "least")
    others = spread.join(least, "sign").where("a > least")
    return others.select(F.col("least").alias("a"), F.col("a").alias("b")).distinct()


def _rarest(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """node, label, n_shingles, signs: the rarest shingles of nodes (node, label) that may have a link to
    another label.

    All shingles have one order: those of a single label first, then by the nodes that have them. A
    set of n shingles shares ``least``, the least whole number from NUM / DEN * n on, with any set that
    it links to. If the first of the shared ones in that order were not among the first n - least + 1
    of the set, at most least - 1 would follow. So both sets have it there.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        names = ["node", "label", "n_shingles", "at", "own"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), kinds, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=names)

        rows, held = [], 0
        for batch in batches:
            for node, label, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = shingles(unpacker.decompress(packed).decode()).view(np.int64)
                rows += [(node, label, len(found), at, found[at : at + ROW]) for at in range(0, len(found), ROW)]
                held += len(found)
                if held > ROWS:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    asked = apart.join(texts, "node").select("node", "label", "packed")
    schema = "node long, label long, n_shingles long, at long, own array<long>"
    sets = stored(asked.mapInArrow(cut, schema), "shingles")
    release(apart.sparkSession)
    used = sets.select(F.explode("own").alias("sign"), "label").groupBy("sign").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")
    )
    used = stored(used.where("low < high").select("sign", "n"), "used")
    release(apart.sparkSession)
    among = (
        sets.select(F.explode("own").alias("sign"), "node").join(used, "sign")
        .groupBy("node").agg(F.collect_list(F.struct("n", "sign")).alias("among"))
    )
    # Of the first ones, as many are of a single label as the set has of these.
    first = F.expr(f"cast(size(among) - ceil({NUM} * n_shingles / {DEN}D) + 1 as int)")
    found = sets.where("at = 0").select("node", "label", "n_shingles").join(among, "node").withColumn("first", first)
    rare = F.slice(F.sort_array("among"), F.lit(1), F.col("first"))["sign"].alias("signs")
    rarest = stored(found.where("first > 0").select("node", "label", "n_shingles", rare), "rarest")
    discard(sets, used)
    release(apart.sparkSession)
    return rarest


def _families(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, n_shingles, label) of different labels that share one of their
    rarest shingles."""
    signs = _rarest(apart, texts)

    def spread(rows: DataFrame, few: bool) -> DataFrame:
        """sign, a: the labels that have a signature, however many of their nodes have it."""
        kept = F.filter("signs", lambda x: (F.pmod(F.xxhash64(x), F.lit(FEW)) == 0) == F.lit(few))
        return rows.select(F.explode(kept).alias("sign"), F.col("label").alias("a")).distinct()

    # Nodes of one label are one, so that a family is told apart by labels. A few signatures join
    # most of a large group; all others are asked for what these have left apart.
    merged = components(_stars(spread(signs, True)))
    release(signs.sparkSession)
    names = merged.select(F.col("node").alias("label"), F.col("label").alias("name"))
    left = signs.select("label", "signs").join(names, "label", "left").select(
        F.coalesce("name", "label").alias("label"), "signs"
    )
    joined = signs.select(F.col("label").alias("a"), F.col("node").alias("b"))
    joined = joined.unionByName(merged.select(F.col("label").alias("a"), F.col("node").alias("b")))
    families = components(_stars(spread(left, False)).unionByName(joined))
    discard(merged)
    release(signs.sparkSession)
    families = families.select("node", F.col("label").alias("family"))
    # Sizes of linked sets differ by a factor of DEN / NUM at most: by one of these classes.
    grade = F.floor(F.log(F.col("n_shingles")) / math.log(DEN / NUM + 0.01)).alias("grade")
    # The weight of a node is its share of a block.
    weight = F.greatest(F.lit(1 / BLOCK), F.col("n_shingles") / BLOCK_SHINGLES).alias("weight")
    members = signs.select("node", "label", "n_shingles", grade, weight).join(families, "node")
    group = ["family", "grade"]
    sizes = members.groupBy(*group, "label").agg(F.sum("weight").alias("n"))
    small = sizes.where(F.col("n") <= 0.5).groupBy(*group).agg(F.sum("n").alias("n_small"))
    # Large components have blocks of their own; the others are dealt out by component.
    members = members.join(sizes, [*group, "label"]).join(small, group, "left")
    own = F.col("n") > 0.5
    block = F.when(
        own, F.xxhash64("grade", "label", F.pmod(F.xxhash64("node"), F.ceil("n")))
    ).otherwise(F.xxhash64("grade", F.pmod(F.xxhash64("label"), F.ceil("n_small"))))
    members = members.select(
        *group, "node", "label", "n_shingles", block.alias("block"), F.when(own, F.col("label")).alias("pure")
    )
    members = stored(members, "family-members")
    blocks = members.groupBy(*group, "block", "pure").agg(F.sum("n_shingles").alias("n"))
    others = blocks.select(
        "family", F.col("grade").alias("other_grade"), F.col("block").alias("other"),
        F.col("pure").alias("other_pure"), F.col("n").alias("other_n"),
    )
    pairs = (
        blocks.join(others, "family").where("block <= other and abs(grade - other_grade) <= 1")
        .where("not (pure is not null and pure <=> other_pure)")
        .select("family", "block", "other", F.expr("n + if(block < other, other_n, 0)").alias("n"))
    )
    pairs = stored(pairs, "block-pairs")
    discard(signs)
    release(members.sparkSession)
    held, dealt = (x.first()[0] or 0 for x in (members.agg(F.sum("n_shingles")), pairs.agg(F.sum("n"))))
    turns = max(1, math.ceil(dealt / max(TIMES * held, FEW_SHINGLES)))
    with_text = members.join(texts, "node").select("family", "block", "node", "label", "packed")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        sets = [shingles(unpacker.decompress(p).decode()) for p in frame["packed"]]
        side, label, node = (frame[c].to_numpy() for c in ("side", "label", "node"))
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(columns):
            columns = rows
        size = np.array([len(x) for x in sets])
        both = shared_counts([sets[i] for i in rows], [sets[i] for i in columns])
        union = size[rows][:, None] + size[columns] - both
        linked = (DEN * both >= NUM * union) & (label[rows][:, None] != label[columns])
        i, j = np.nonzero(linked)
        # One link of each two components tells that they are one.
        found = pd.DataFrame(
            {"a": node[rows][i], "b": node[columns][j], "x": label[rows][i], "y": label[columns][j]}
        )
        return found.drop_duplicates(["x", "y"])[["a", "b"]]

    links = None
    for turn in range(turns):
        now = pairs.where(F.pmod(F.xxhash64("block", "other", "family"), F.lit(turns)) == turn).drop("n")
        left = with_text.join(now, ["family", "block"]).withColumn("side", F.lit(0))
        right = with_text.withColumnRenamed("block", "other").join(
            now.where("block < other"), ["family", "other"]
        ).withColumn("side", F.lit(1))
        both = left.unionByName(right).groupBy("family", "block", "other")
        found = stored(both.applyInPandas(compare, "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        release(members.sparkSession)
    discard(members, pairs)
    return links


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8_192) -> np.ndarray:
    """Elements that each set on the left shares with each on the right."""
    flat_left, flat_right = np.concatenate(left), np.concatenate(right)
    known = np.intersect1d(flat_left, flat_right)
    out = np.zeros((len(left), len(right)), np.int64)

    def places(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(known, flat)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == flat[hit]
        return row[hit], at[hit]

    (row_l, at_l), (row_r, at_r) = places(left, flat_left), places(right, flat_right)
    for low in range(0, len(known), width):
        a = np.zeros((len(left), min(width, len(known) - low)), np.float32)
        b = np.zeros((len(right), a.shape[1]), np.float32)
        own_l, own_r = (at_l >= low) & (at_l < low + width), (at_r >= low) & (at_r < low + width)
        a[row_l[own_l], at_l[own_l] - low] = 1
        b[row_r[own_r], at_r[own_r] - low] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    sets = stored(_sets(docs), "sets")
    nodes = (
        sets.where("n_shingles > 0")
        .groupBy("digest", "key", "n_shingles")
        .agg(F.min(F.struct("id", "text_digest")).alias("row"), F.min("doc_id").alias("least"))
        .select("digest", "key", "n_shingles", "row.*", "least")
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stored(nodes, "nodes")
    release(spark)

    # Signatures of more than one node, with their nodes. Copies fall together before the shuffle.
    signs = sets.select(F.explode("signs").alias("sign"), "key")
    shared = signs.groupBy("sign").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = stored(shared.where("low < high").select("sign"), "shared")
    release(spark)
    # Different sets with equal 64-bit keys are brought together by the key itself.
    twice = nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    same_key = nodes.join(twice, "key").select(F.col("key").alias("sign"), "node", "n_shingles")
    members = signs.join(shared, "sign").distinct().join(nodes.select("key", "node", "n_shingles"), "key")
    members = stored(
        members.select("sign", "node", "n_shingles").unionByName(same_key), "members"
    )
    discard(shared)
    release(spark)
    wanted = members.select("node").distinct().join(nodes.select("node", "id", "text_digest"), "node")
    texts = stored(_texts(docs, wanted), "texts")
    release(spark)

    fits = F.least("n_a", "n_shingles") * DEN >= F.greatest("n_a", "n_shingles") * NUM
    links = None
    groups = members.withColumn("label", F.col("node"))
    for turn in range(HUBS + 1):
        # Groups of near copies share most signatures: a few of these make them one component, and what
        # one component has to itself is not joined any more. Nothing else is left out for long.
        asked = groups if turn else groups.where(F.pmod(F.xxhash64("sign"), F.lit(FEW)) == 0)
        # A hub for every signature: the smallest by an order that changes with the turn.
        order = F.struct(F.xxhash64("node", F.lit(turn)), "node", "n_shingles", "label")
        hubs = asked.groupBy("sign").agg(F.min(order).alias("hub"))
        hubs = hubs.select(
            "sign", F.col("hub.node").alias("a"), F.col("hub.n_shingles").alias("n_a"),
            F.col("hub.label").alias("label_a"),
        )
        pairs = (
            asked.join(hubs, "sign").where((F.col("label_a") != F.col("label")) & fits)
            .groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
            .where("n > 1").select("a", "b")
        )
        found = stored(_linked(pairs, texts), "links")
        links = found if links is None else links.unionByName(found)
        release(spark)
        labels = components(links)
        release(spark)
        before = groups
        groups = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = groups.groupBy("sign").agg(F.min("label").alias("l"), F.max("label").alias("h"))
        groups = stored(groups.join(several.where("l < h").select("sign"), "sign"), "groups")
        discard(labels, *[before] * bool(turn))
        release(spark)
    links = links.unionByName(_families(groups.select("node", "n_shingles", "label").distinct(), texts))
    labels = components(links)
    discard(members, texts, groups)

    whole = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = whole.join(least, "label").select("digest", "component_id")
    return sets.join(of_node, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one it is named after.

    Documents without id stay when their component has no id.
    """
    found = join(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
