"""The trie of conversation prefixes, by union-find over the prefixes that sorted neighbours share.

A conversation is the sequence of its turns; a turn is the 128 leading bits of the SHA-256 of its
role and text, so texts do not travel. Equal sequences become one row. Rows are sorted over the
cluster, and each range of them is a forest of its own:

* Between neighbours lies an edge, as deep as the prefix that they share. Edges are taken in
  descending depth, and union-find joins the two components beside an edge. Every join makes a
  branching node at that depth, or widens one that is there already; what lies between a component's
  top and the new node is a chain.
* The prefix shared with the neighbour in the range before or behind is known from the ranges' first
  and last rows. Nodes on such a prefix go on in another range. A forest is contracted to these open
  paths; all other nodes are final.
* Open paths of all ranges are merged by their prefix. What a range adds to an open node counts only
  what begins in that range, so merging is adding.

One row holds 24 bytes a turn of one conversation; a range is as large as a shuffle partition. Ids of
copies travel in runs of at most ``RUN`` and are hashed as a stream.

Defined cases: rows without a conv_id take no part; null roles and texts are empty; turns are ordered
by turn (null first), equal turns by their digest, and repeated rows are several turns; ``%`` keeps
the sign of a negative conv_id; a conversation rebuilt without turns is a member of the root; an
empty table has no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import stored, table

#: Bytes of a turn's digest.
TURN = 16
#: Width of the id range whose copies travel together.
RUN = 1 << 12
#: How the query rebuilds conversations: groups of so many ids share the first turns of the first.
FAMILY, HEAD = 5, 9


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq: the ordered turns (digest, bytes) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn").alias("turn"),
            F.substring(F.sha2(whole, 256), 1, 2 * TURN).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["digest"], t["bytes"])).alias("seq")
    )


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first of their family."""
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEAD)).cast("int")
    heads = seqs.where(c % FAMILY == 0).select(
        c.alias("first_id"), F.slice("seq", 1, HEAD - 1).alias("head")
    )
    own = seqs.withColumn("first_id", c - c % FAMILY).withColumn("h", h)
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    none = F.slice("seq", 1, 0)
    return own.join(heads, "first_id", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), rest).alias("seq")
    )


def _ranges(seqs: DataFrame) -> DataFrame:
    """part, key, sizes, n, least, ends: the distinct sequences, sorted and cut into ranges.

    ``key`` is the digests in a row, ``sizes`` the bytes of the turns, ``n`` the copies, ``least`` the
    smallest conv_id and ``ends`` the hash of all of them.
    """
    keyed = seqs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), "")).alias("key"),
        F.transform("seq", lambda t: t["bytes"]).alias("sizes"),
        F.shiftright("conv_id", 12).alias("run"),
    )
    runs = keyed.groupBy("key", "sizes", "run").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select(
        "key", "sizes", "run", F.size("ids").alias("n"), F.col("ids")[0].alias("least"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["part", "key", "sizes", "n", "least", "ends"]
        types = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        done, key, sizes, n, least, ends = [], None, None, 0, None, None
        for batch in batches:
            for k, s, count, first, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    n, least = n + count, min(least, first)
                    ends.update(f",{ids}".encode())
                    continue
                if key is not None:
                    done.append((part, key, sizes, n, least, ends.hexdigest()))
                    if len(done) >= 2_000:
                        yield flush(done)
                        done = []
                key, sizes, n, least, ends = k, s, count, first, hashlib.sha256(ids.encode())
        if key is not None:
            done.append((part, key, sizes, n, least, ends.hexdigest()))
        if done:
            yield flush(done)

    schema = "part int, key binary, sizes array<long>, n long, least long, ends string"
    rows = runs.repartitionByRange("key").sortWithinPartitions("key", "run")
    rows = rows.select("key", "sizes", F.col("n").cast("long").alias("n"), "least", "ids")
    return stored(rows.mapInArrow(merge, schema), "sequences")


def shared(a: bytes, b: bytes) -> int:
    """Turns at the start that two sequences have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // TURN


class _Forest:
    """The forest of one range of sorted distinct sequences.

    ``before`` and ``behind`` are the neighbours in other ranges, or None. A component of rows has a
    top node; nodes are numbered as they are made, and equal branching nodes are one by ``find``.
    """

    def __init__(self, before: bytes | None, behind: bytes | None):
        self.before, self.behind = before, behind
        self.keys: list[bytes] = []
        self.rows: list[tuple] = []

    def add(self, key: bytes, sizes: list[int], n: int, least: int, ends: str) -> None:
        self.keys.append(key)
        self.rows.append((sizes, n, least, ends))

    def find(self, x: int) -> int:
        while self.into[x] != x:
            self.into[x] = x = self.into[self.into[x]]
        return x

    def _node(self, depth, row, n, least, ends, first, last) -> int:
        self.into.append(len(self.into))
        self.up.append(-1)
        self.depth.append(depth)
        self.row.append(row)
        self.n.append(n)
        self.least.append(least)
        self.ends.append(ends)
        self.span.append((first, last))
        self.inner.append(False)
        self.children.append(0)
        self.leaves.append(0)
        self.saved.append(0)
        return len(self.into) - 1

    def _closing(self, x: int) -> None:
        """Settle what node x itself adds, once nothing more joins it."""
        first, last = self.span[x]
        d, m = self.depth[x], len(self.keys) - 1
        goes_on = last == m and d <= self.right
        if not self.inner[x] and not (goes_on and self.right_extends):
            self.leaves[x] += 1
        begun = not (first == 0 and d <= self.left)
        if d:
            self.saved[x] += (self.n[x] - begun) * self.rows[self.row[x]][0][d - 1]

    def _lift(self, x: int, depth: int) -> int:
        """The node at ``depth`` above top node x; a chain leads there."""
        while self.depth[x] > depth:
            self._closing(x)
            first, last = self.span[x]
            above = self._node(self.depth[x] - 1, self.row[x], self.n[x], self.least[x], None, first, last)
            self.up[x] = above
            self.inner[above] = True
            self.children[above] = 0 if first == 0 and self.depth[x] <= self.left else 1
            self.leaves[above], self.saved[above] = self.leaves[x], self.saved[x]
            x = above
        return x

    def grow(self) -> None:
        m = len(self.keys)
        self.left = shared(self.before, self.keys[0]) if self.before is not None else -1
        self.right = shared(self.keys[-1], self.behind) if self.behind is not None else -1
        # The next range begins with an extension of the last row.
        self.right_extends = self.right * TURN == len(self.keys[-1])
        self.into, self.up, self.depth, self.row, self.n, self.least = [], [], [], [], [], []
        self.ends, self.span, self.inner, self.children, self.leaves, self.saved = [], [], [], [], [], []
        for i, (_, n, least, ends) in enumerate(self.rows):
            self._node(len(self.keys[i]) // TURN, i, n, least, ends, i, i)
        comp, top = list(range(m)), list(range(m))

        def component(i: int) -> int:
            while comp[i] != i:
                comp[i] = i = comp[comp[i]]
            return i

        edges = [shared(a, b) for a, b in zip(self.keys, self.keys[1:])]
        for i in sorted(range(m - 1), key=edges.__getitem__, reverse=True):
            a, b = component(i), component(i + 1)
            x, y = self._lift(top[a], edges[i]), self._lift(top[b], edges[i])
            comp[b] = a
            top[a] = x
            self.into[y] = x
            self.n[x] += self.n[y]
            self.least[x] = min(self.least[x], self.least[y])
            self.ends[x] = self.ends[x] or self.ends[y]
            self.span[x] = (self.span[x][0], self.span[y][1])
            self.inner[x] |= self.inner[y]
            self.children[x] += self.children[y]
            self.leaves[x] += self.leaves[y]
            self.saved[x] += self.saved[y]
        self.root = self._lift(top[component(0)], 0)
        self._closing(self.root)

    def _prefixes(self, i: int, depth: int) -> list[bytes]:
        """Digests of the prefixes of row i, up to a depth."""
        h, out = hashlib.sha256(), [hashlib.sha256().digest()]
        for d in range(depth):
            h.update(self.keys[i][TURN * d : TURN * (d + 1)])
            out.append(h.copy().digest())
        return out

    def nodes(self) -> Iterator[tuple]:
        """open, prefix, parent (prefix, where the parent is open), conv_id, depth, parent_conv_id,
        n_convs, n_children, n_leaves, saved_tokens, ends."""
        self.grow()
        m = len(self.keys) - 1
        head, tail = self._prefixes(0, max(self.left, 0)), self._prefixes(m, max(self.right, 0))

        def prefix(x: int) -> bytes | None:
            """The digest of an open node."""
            (first, last), d = self.span[x], self.depth[x]
            if first == 0 and d <= max(self.left, 0):
                return head[d]
            return tail[d] if last == m and d <= max(self.right, 0) else None

        for x in range(len(self.into)):
            if self.into[x] != x:
                continue
            up = -1 if self.up[x] < 0 else self.find(self.up[x])
            own, above = prefix(x), None if up < 0 else prefix(up)
            yield (
                own is not None, own, above, self.least[x], self.depth[x],
                None if up < 0 or above is not None else self.least[up],
                self.n[x], self.children[x], self.leaves[x], self.saved[x], self.ends[x],
            )


_NODES = (
    "open boolean, prefix binary, parent binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_TYPES = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]


def _forests(ranges: DataFrame) -> DataFrame:
    """The nodes of the forest of each range."""
    from pyspark.sql import Window

    ends = ranges.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # One row per range.
    order = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("behind"))
    none = {"sizes": "array<long>", "n": "long", "least": "long", "ends": "string"}

    def beside(name: str, place: int) -> DataFrame:
        empty: list[Column] = [F.lit(None).cast(t).alias(c) for c, t in none.items()]
        return ends.select("part", F.lit(place).alias("place"), F.col(name).alias("key"), *empty)

    # A range's rows come between its neighbours.
    rows = ranges.select("part", F.lit(1).alias("place"), "key", *none)
    rows = rows.unionByName(beside("before", 0)).unionByName(beside("behind", 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _NODES.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names)

        forest = None
        for batch in batches:
            for _, place, key, sizes, n, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    forest = _Forest(key, None)
                elif place == 1:
                    forest.add(key, sizes, n, least, ends)
                else:
                    forest.behind = key
                    held = []
                    for node in forest.nodes():
                        held.append(node)
                        if len(held) >= 10_000:
                            yield flush(held)
                            held = []
                    yield flush(held)
                    forest = None

    return rows.repartition("part").sortWithinPartitions("part", "place", "key").mapInArrow(run, _NODES)


def trie(seqs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, seq of digest and bytes)."""
    nodes = stored(_forests(_ranges(seqs)), "forests")
    open_ = nodes.where("open").groupBy("prefix", "depth").agg(
        F.first("parent", True).alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    # Two paths of ranges, at most, per range: small beside the nodes.
    open_ = stored(open_, "open-paths")
    above = open_.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("above"))
    closed = nodes.where("not open and parent is null")
    hung = nodes.where("not open and parent is not null").drop("prefix", "parent_conv_id")
    merged = open_.drop("prefix").unionByName(hung.drop("open"))
    merged = merged.join(above, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = closed.select(*columns).unionByName(merged.select(*columns))
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", none))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


#: Hash of conv_id bit by bit: DuckDB has no CRC-32.
SQL = """
WITH t AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST) AS seq
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (
  SELECT conv_id, seq, conv_id - conv_id % 5 AS first_id,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
             string_split(CAST(conv_id AS VARCHAR), ''),
             lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], [CAST(-1 AS BIGINT), -1, -1, -1, -1, -1, -1, -1])))),
           lambda c, b: CASE WHEN b >= 0 THEN xor(c, b)
                             ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END)) % 9 AS h
  FROM t),
b AS (
  SELECT o.conv_id, list_concat(coalesce(f.seq, [])[1:o.h], o.seq[o.h + 1:len(o.seq)]) AS seq
  FROM o LEFT JOIN t f ON f.conv_id = o.first_id),
p AS (
  SELECT conv_id, d AS depth, seq[1:d] AS prefix, CASE WHEN d > 0 THEN seq[1:d - 1] END AS above,
         CASE WHEN d > 0 THEN octet_length(encode(seq[d].t)) ELSE 0 END AS bytes, d = len(seq) AS ends
  FROM b, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS (
  SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY depth, prefix),
k AS (SELECT above AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, prefix)),
s AS (
  SELECT a.d AS depth, w.prefix[1:a.d] AS prefix, sum((n_convs - 1) * bytes) AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves
  FROM w, unnest(range(0, w.depth + 1)) AS a(d) GROUP BY ALL)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, w.n_convs,
       CAST(w.n_children AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       w.ends_sha256
FROM w JOIN s USING (depth, prefix) LEFT JOIN w q ON q.depth = w.depth - 1 AND q.prefix = w.above
"""
