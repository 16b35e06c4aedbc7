"""Removal of bytes that stand in a repeated string of 200 bytes, by merged suffix transforms.

Not all suffixes are sorted: a repeated string has the same anchors in all its places (see
``suffixes``), so only the suffixes at anchors are in a transform, each with the bytes before it.

1. Anchors are counted by gram, then by gram and context, in aggregates that are reduced before
   the shuffle. An anchor whose gram occurs once is in no repeated string; of anchors whose whole
   context occurs twice all strings are repeated. What remains are grams with several contexts.
2. One of each such context goes to its gram's task. A task receives its contexts in shards, sorts
   each shard's suffixes, and merges these orders by iterative interleave refinement. That gives
   common prefixes and repeated intervals; two members of an interval with the same bytes before
   them hold a repeated string. A context yields one span, since its strings overlap.
3. Grams with more than ``MANY`` contexts never meet in a task. Their strings are taken ``RANGE``
   starts at a time and counted by the hash of what these have in common; only where contexts of
   a range differ are its strings counted one by one, all in aggregates as above.
4. Spans return to their texts by row number, and the rest of the bytes is kept.

Strings are compared by 64-bit hashes of them or of parts; matches never leave a document.

Defined cases: null and texts below 200 bytes lose nothing; rows that repeat a document are places
of their own, so both lose everything (200 bytes and more); a null doc_id is an id like others; an
empty table gives an empty result; further columns are ignored, and ``drop_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from stopwise.llm.common import body, discard, release, stored, table
from stopwise.llm.shingles import mix
from stopwise.llm.suffixes import BEFORE, LENGTH, WIDE, anchors, repeated, side_hashes

#: Contexts of one gram that may meet in a task, string starts taken together beyond that, and
#: contexts that are merged at a time.
MANY = 512
RANGE = 8
CHUNK = 16_384


def _numbered(docs: DataFrame) -> DataFrame:
    """row (fixed by being written), doc (all columns but the text), packed text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.as_py().encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"]
            )

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("doc"), body().alias("text"))
    schema = StructType([rows.schema["doc"], StructField("packed", BinaryType())])
    packed = rows.mapInArrow(pack, schema)
    return stored(packed.withColumn("row", F.monotonically_increasing_id()), "texts")


def _anchors(texts: DataFrame) -> DataFrame:
    """row, at, gram, context, weight; ``local`` marks further places of a context in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()

        def flush(parts):
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["row", "at", "gram", "context", "weight", "local"]
            )

        for batch in batches:
            parts, size = [], 0
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = np.frombuffer(unpacker.decompress(packed.as_py()), np.uint8)
                at, grams, contexts = anchors(text)
                if not len(at):
                    continue
                _, first, inverse, counts = np.unique(
                    contexts, return_index=True, return_inverse=True, return_counts=True
                )
                local = np.ones(len(at), bool)
                local[first] = False
                parts.append((
                    np.full(len(at), row, np.int64), at.astype(np.int32), grams.view(np.int64),
                    contexts.view(np.int64), np.minimum(counts[inverse], 2).astype(np.int32), local,
                ))
                size += len(at)
                if size > 50_000:
                    yield flush(parts)
                    parts, size = [], 0
            if parts:
                yield flush(parts)

    schema = "row long, at int, gram long, context long, weight int, local boolean"
    return texts.select("row", "packed").mapInArrow(run, schema)


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, row, at, weight, many, left, right: the bytes around the wanted anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        names = ["gram", "row", "at", "weight", "many", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

        def flush(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names
            )

        for batch in batches:
            out = []
            for row, packed, own in zip(*batch.columns, strict=True):
                text = unpacker.decompress(packed.as_py())
                for a in own.as_py():
                    at = a["at"]
                    left, right = text[max(0, at - BEFORE) : at], text[at : at + LENGTH]
                    out.append((a["gram"], row.as_py(), at, a["weight"], a["many"], left, right))
                if len(out) > 20_000:
                    yield flush(out)
                    out = []
            if out:
                yield flush(out)

    own = wanted.groupBy(F.col("row").alias("of")).agg(
        F.collect_list(F.struct("gram", "at", "weight", "many")).alias("own")
    )
    both = texts.join(own, texts["row"] == own["of"]).select("row", "packed", "own")
    schema = "gram long, row long, at int, weight int, many boolean, left binary, right binary"
    return both.mapInArrow(run, schema)


def _merged(contexts: DataFrame) -> DataFrame:
    """row, start, stop of contexts that share a string with another one of their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts)
            gram = whole.column("gram").to_numpy()
            least, most = repeated(
                gram, whole.column("left").to_pylist(), whole.column("right").to_pylist(),
                [p.num_rows for p in parts],
            )
            at = whole.column("at").to_numpy().astype(np.int64)
            rows = whole.column("row").to_numpy()
            found = (most >= 0) & (whole.column("weight").to_numpy() < 2)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[found]),
                    pa.array((at - most)[found]),
                    pa.array((at - least + LENGTH)[found]),
                ],
                names=["row", "start", "stop"],
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            # The last gram may go on in the next batch; it has at most MANY contexts.
            last = held[-1].column(0)[-1].as_py()
            split = [int(np.searchsorted(b.column(0).to_numpy(), last)) for b in held]
            ready = [b.slice(0, n) for b, n in zip(held, split, strict=True) if n]
            held = [b.slice(n) for b, n in zip(held, split, strict=True) if n < b.num_rows]
            if ready:
                yield settle(ready)
        if held:
            yield settle(held)

    columns = contexts.select("gram", "row", "at", "weight", "left", "right")
    dealt = columns.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "row long, start long, stop long")


def _hashed(contexts: DataFrame, schema: str, rows_of: Callable) -> DataFrame:
    """Rows that ``rows_of`` makes of a batch and the hashes of its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4_096):
                part = batch.slice(low, 4_096)
                lefts, rights = part.column("left").to_pylist(), part.column("right").to_pylist()
                _, before = side_hashes(lefts, BEFORE, backwards=True)
                _, after = side_hashes(rights, LENGTH, backwards=False)
                n_left = np.array([len(x) for x in lefts])
                n_right = np.array([len(x) for x in rights])
                yield from rows_of(part, before, after, n_left, n_right)

    return contexts.mapInArrow(run, schema)


def _range_rows(part, before, after, n_left, n_right) -> Iterator[pa.RecordBatch]:
    """Per context and range of starts: hash of what its strings share, and of all their bytes."""
    gram = part.column("gram").to_numpy().view(np.uint64)
    for r in range(0, BEFORE + 1, RANGE):
        far = min(r + RANGE - 1, BEFORE)
        low, high = np.maximum(r, LENGTH - n_right), np.minimum(far, n_left)
        some = np.flatnonzero(low <= high)
        if not len(some):
            continue
        core = mix(before[r] * WIDE + after[LENGTH - far] + np.uint64(r)) ^ mix(gram)
        wide_left, wide_right = np.minimum(far, n_left), np.minimum(LENGTH - r, n_right)
        i = np.arange(len(gram))
        shape = (wide_left * (LENGTH + 1) + wide_right).astype(np.uint64)
        whole = mix(before[wide_left, i] * WIDE + after[wide_right, i] + mix(shape))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(core[some].view(np.int64)),
                pa.array(whole[some].view(np.int64)),
                *[part.column(c).take(pa.array(some)) for c in ("row", "at", "weight")],
                pa.array(np.full(len(some), r, np.int32)),
                pa.array(low[some].astype(np.int32)),
                pa.array(high[some].astype(np.int32)),
            ],
            names=["core", "whole", "row", "at", "weight", "range", "low", "high"],
        )


def _string_rows(part, before, after, n_left, n_right) -> Iterator[pa.RecordBatch]:
    """The strings of the ranges that each context still has to look at."""
    gram = part.column("gram").to_numpy().view(np.uint64)
    asked = part.column("ranges").to_pylist()
    for back in range(BEFORE + 1):
        r = back - back % RANGE
        some = np.array([r in x for x in asked]) & (n_left >= back) & (n_right >= LENGTH - back)
        some = np.flatnonzero(some)
        if not len(some):
            continue
        string = mix(before[back] * WIDE + after[LENGTH - back] + np.uint64(back)) ^ mix(gram)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(string[some].view(np.int64)),
                *[part.column(c).take(pa.array(some)) for c in ("row", "at", "weight")],
                pa.array(np.full(len(some), back, np.int32)),
            ],
            names=["string", "row", "at", "weight", "back"],
        )


def _counted(contexts: DataFrame) -> DataFrame:
    """As ``_merged``, for grams with any number of contexts."""
    contexts = stored(contexts, "many")
    ranges = stored(
        _hashed(
            contexts,
            "core long, whole long, row long, at int, weight int, range int, low int, high int",
            _range_rows,
        ),
        "ranges",
    )
    seen = (
        ranges.groupBy("core")
        .agg(F.sum("weight").alias("n"), F.min("whole").alias("w1"), F.max("whole").alias("w2"))
        .where("n > 1")
    )
    both = stored(ranges.join(seen, "core"), "shared-ranges")
    settled = both.where("w1 = w2").select("row", "at", "weight", "low", "high")
    open_ranges = (
        both.where("w1 <> w2").groupBy("row", "at").agg(F.collect_set("range").alias("ranges"))
    )
    asked = contexts.join(open_ranges, ["row", "at"])
    strings = stored(
        _hashed(asked, "string long, row long, at int, weight int, back int", _string_rows), "strings"
    )
    twice = strings.groupBy("string").agg(F.sum("weight").alias("n")).where("n > 1").select("string")
    found = strings.join(twice, "string").select(
        "row", "at", "weight", F.col("back").alias("low"), F.col("back").alias("high")
    )
    return (
        settled.unionByName(found)
        .where("weight < 2")
        .groupBy("row", "at")
        .agg(F.min("low").alias("least"), F.max("high").alias("most"))
        .select(
            "row",
            (F.col("at") - F.col("most")).cast("long").alias("start"),
            (F.col("at") - F.col("least") + LENGTH).cast("long").alias("stop"),
        )
    )


def _spans(texts: DataFrame, many: int) -> DataFrame:
    """row, start, stop: all repeated strings lie in these; stop may pass the end of the text."""
    spark = texts.sparkSession
    found = stored(_anchors(texts), "anchors")
    release(spark)
    places = found.where("not local").select("row", "at", "gram", "context", "weight")
    grams = (
        places.groupBy("gram")
        .agg(F.sum("weight").alias("n"), F.min("context").alias("c1"), F.max("context").alias("c2"))
        .where("n > 1")
        .select("gram", (F.col("c1") == F.col("c2")).alias("equal"))
    )
    grams = stored(grams, "grams")
    release(spark)
    shared = stored(places.join(grams, "gram"), "shared")
    release(spark)
    mixed = shared.where("not equal")
    kinds = mixed.groupBy("gram", "context").agg(
        F.sum("weight").alias("n"), F.min(F.struct("row", "at")).alias("one")
    )
    kinds = stored(kinds, "kinds")
    sizes = kinds.groupBy("gram").agg((F.count("*") > many).alias("many"))
    wanted = kinds.join(sizes, "gram").select(
        "gram", "one.row", "one.at", F.least("n", F.lit(2)).cast("int").alias("weight"), "many"
    )
    several = kinds.where("n > 1").select("gram", "context")
    whole = (
        shared.where("equal").select("row", "at")
        .unionByName(mixed.join(several, ["gram", "context"], "left_semi").select("row", "at"))
        .unionByName(found.where("local").select("row", "at"))
    )
    whole = whole.select(
        "row",
        F.greatest(F.col("at") - BEFORE, F.lit(0)).cast("long").alias("start"),
        (F.col("at") + LENGTH).cast("long").alias("stop"),
    )
    whole, wanted = stored(whole, "whole-contexts"), stored(wanted, "wanted")
    discard(found, grams, shared, kinds)
    release(spark)
    contexts = stored(_contexts(texts, wanted), "contexts")
    discard(wanted)
    release(spark)
    spans = whole.unionByName(_merged(contexts.where("not many")))
    spans = spans.unionByName(_counted(contexts.where("many")))
    spans = stored(spans, "spans")
    discard(whole, contexts)
    release(spark)
    return spans


def keep(docs: DataFrame, many: int = MANY, as_text: bool = False) -> DataFrame:
    """doc (a struct of all columns but the text), kept (the remaining bytes), n_bytes and spans
    (removed start and stop) per document. As text, kept has the whole characters that remain."""
    texts = _numbered(docs)
    spans = _spans(texts, many)
    own = spans.groupBy(F.col("row").alias("of")).agg(
        F.collect_list(F.struct("start", "stop")).alias("own")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.string() if as_text else pa.binary(), pa.int64(), span]

        def flush(batch, first, out):
            found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(out)), *found],
                names=["doc", "kept", "n_bytes", "spans"],
            )

        for batch in batches:
            out, size, first = [], 0, 0
            for packed, own in zip(batch.column(1), batch.column(2), strict=True):
                text, gone, rest, end = unpacker.decompress(packed.as_py()), [], [], 0
                for start, stop in sorted((s["start"], s["stop"]) for s in own.as_py() or ()):
                    stop = min(stop, len(text))
                    # A context that is cut by the ends of its text may be too short for a string.
                    if stop - start < LENGTH:
                        continue
                    if gone and start <= gone[-1]["stop"]:
                        gone[-1]["stop"] = max(gone[-1]["stop"], stop)
                    else:
                        gone.append({"start": start, "stop": stop})
                for g in gone:
                    rest.append(text[end : g["start"]])
                    end = g["stop"]
                rest.append(text[end:])
                kept = b"".join(rest)
                out.append((kept.decode("utf-8", "ignore") if as_text else kept, len(text), gone))
                size += len(text)
                if size > 8 << 20:
                    yield flush(batch, first, out)
                    first += len(out)
                    out, size = [], 0
            if out:
                yield flush(batch, first, out)

    both = texts.join(own, texts["row"] == own["of"], "left").select("doc", "packed", "own")
    removed = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    schema = StructType(
        [both.schema["doc"], StructField("kept", StringType() if as_text else BinaryType()),
         StructField("n_bytes", LongType()), StructField("spans", removed)]
    )
    return both.mapInArrow(run, schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; characters that were cut apart go.

    ``n_chars``, where there is one, is counted anew.
    """
    left = keep(docs, as_text=True)
    columns = {c: F.col("doc").getField(c) for c in docs.columns if c != "text"}
    columns["text"] = F.col("kept")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.length(columns["text"]).cast(kind)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keep(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
