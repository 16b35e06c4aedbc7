"""BPE encoding and decoding by a distinct-word table.

Texts are split into words in Spark tasks. The table of distinct words has two parts. The
``HEAD`` most frequent words, a bounded number, are encoded once and joined to the documents on
the map side, from a broadcast. All other words leave their documents as rows (doc_id, word), are
brought together by word, encoded once each, and their ids return to the documents by doc_id, where
they are put back at the positions of their words. Frequent words never travel, so no word can
hold a large share of the rows that do; texts travel once, compressed.

Decoding looks every id up in the id-to-piece table, whose size is that of the vocabulary, and
joins the pieces as the tokenizer does (it has no decoder: by blanks), text by text.

Which words are in the head touches speed only. Its candidates are words that occur ``AGAIN`` times
among the words one task has counted at a time.

No stage passes its rows through Python twice, so an executor has one Python process per core. The
constants below bound how many words and chunks a process remembers.

Defined cases: null and empty texts have no ids and decode to an empty text; rows with a null doc_id
are each for themselves; rows that repeat a doc_id keep their own texts; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import body, release, table
from stopwise.llm.words import chunks, cut, default_path, words_of

#: Words of the broadcast part, the longest of them, and how often a task must see a candidate.
HEAD = 500_000
LONGEST = 24
AGAIN = 2
#: Distinct chunks that a task counts at a time, and whose words or ids it remembers.
COUNTED = 400_000
REMEMBERED = 200_000


def _head(docs: DataFrame, size: int) -> DataFrame:
    """The most frequent words (word, n), at most ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush():
            found: dict[str, int] = {}
            while seen:  # chunks go as their words come, so that not all of both are held
                chunk, n = seen.popitem()
                for w in cut(chunk):
                    found[w] = found.get(w, 0) + n
            seen.clear()
            often = [w for w, n in found.items() if n >= AGAIN and len(w) <= LONGEST]
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(often, pa.string()), "n": pa.array(map(found.__getitem__, often), pa.int64())}
            )

        for batch in batches:
            for text in batch.column(0):
                seen.update(chunks(text.as_py()))
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    found = docs.select(body().alias("text")).mapInArrow(count, "word string, n long")
    return (
        found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    )


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """Replace the last column, a word, by ``pair``: the word, a line feed and its ids.

    Ids are as narrow as the vocabulary allows. No word holds a line feed, and one column takes fewer
    bytes than two. Rows that are sorted by word have each distinct word encoded once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = words_of(path), {}
        kind = words.narrow()
        for batch in batches:
            column = batch.column(batch.num_columns - 1).to_pylist()
            new = [w for w in dict.fromkeys(column) if w not in last]
            pairs = [w.encode() + b"\n" + i for w, i in zip(new, words.encode(new, kind), strict=True)]
            known = last | dict(zip(new, pairs, strict=True))
            # A word goes on in the next batch only if it ends this one.
            last = {column[-1]: known[column[-1]]} if column else last
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(map(known.__getitem__, column), pa.binary())],
                names=[*batch.schema.names[:-1], "pair"],
            )

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encode, f"{kept}pair binary")


def _apart(pairs: Iterable[bytes]) -> dict[str, bytes]:
    """Words and their ids, of the pairs of ``encode_words``."""
    return {w.decode(): ids for w, _, ids in (p.partition(b"\n") for p in pairs)}


def encode(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, in order) and decoded text per document."""
    return _encode(docs, path or default_path(), head, digests=False)


def digest_tokens(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document."""
    return _encode(docs, path or default_path(), head, digests=True)


def _encode(docs: DataFrame, path: str, head: int, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    often = encode_words(_head(docs, head).select("word"), path).toArrow()
    shared = spark.sparkContext.broadcast(_apart(p.as_py() for p in often.column("pair")))
    del often
    release(spark)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tails: dict[str, tuple[str, ...]] = {}

        def flush(ids, words):
            return pa.RecordBatch.from_pydict(
                {"of": pa.array(ids, pa.int64()), "word": pa.array(words, pa.string())}
            )

        for batch in batches:
            ids, words = [], []
            for key, text in zip(*batch.columns, strict=True):
                # Chunks that are a word of the broadcast part need no room here.
                parts = set(chunks(text.as_py())).difference(known)
                if len(tails) > REMEMBERED:
                    tails.clear()
                for c in parts.difference(tails):
                    tails[c] = tuple([w for w in cut(c) if w not in known])
                own = {w for c in parts for w in tails[c]}
                ids.extend([key.as_py()] * len(own))
                words.extend(own)
                if len(ids) > 100_000:
                    yield flush(ids, words)
                    ids, words = [], []
            yield flush(ids, words)

    # Rows without an id go by their text. Words mean the same in every document, so rows may share
    # a key: each then gets the words of all of them, every word once.
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(
        F.coalesce(doc_id, F.xxhash64("text")).alias("key"), body().alias("text"), doc_id.alias("doc_id")
    )
    tail = source.select("key", "text").mapInArrow(rare, "of long, word string")
    pairs = encode_words(tail.repartition("word").sortWithinPartitions("word"), path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(t.as_py().encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()), batch.column(2)],
                names=["key", "packed", "doc_id"],
            )

    own = pairs.groupBy("of").agg(F.collect_set("pair").alias("rare"))
    packed = source.mapInArrow(pack, "key long, packed binary, doc_id long")
    both = packed.join(own, packed["key"] == own["of"], "left").select("doc_id", "packed", "rare")

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known, unpacker = shared.value, zstandard.ZstdDecompressor()
        kind, piece = words_of(path).narrow(), words_of(path).spelled
        done: dict[str, bytes] = {}

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = unpacker.decompress(batch.column(1)[i].as_py()).decode()
                own = _apart(batch.column(2)[i].as_py() or ())
                parts = chunks(text)
                if len(done) > REMEMBERED:
                    done.clear()
                for c in set(parts).difference(done):
                    found = known.get(c)
                    if found is None:
                        found = b"".join([known[w] if w in known else own[w] for w in cut(c)])
                    done[c] = found
                numbers = np.frombuffer(b"".join(map(done.__getitem__, parts)), kind)
                ids = numbers.astype("<u4").tobytes()
                back = " ".join(map(piece.__getitem__, numbers.tolist()))
                if digests:
                    out.append((
                        len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                        hashlib.sha256(back.encode()).hexdigest(),
                    ))
                else:
                    out.append((ids, back))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", *names],
            )

    if digests:
        names, kinds = ("n_tokens", "ids_sha256", "decoded_sha256"), (pa.int64(), pa.string(), pa.string())
        schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        names, kinds = ("ids", "decoded"), (pa.binary(), pa.string())
        schema = "doc_id long, ids binary, decoded string"
    return both.mapInArrow(put_back, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(table(spark, sf_dir, "documents"))
