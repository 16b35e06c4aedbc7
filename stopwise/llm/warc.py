"""WARC archives: write pages as records, one gzip member each, and read them back in sequence.

Writing: each task writes the records of its partition into one file in the shared folder, under
a name of its own, and returns the name; files of tasks that were lost or repeated are not named in
the returned list and so never read. Of records with equal payloads of at least ``MIN_REVISIT``
bytes, the one with the largest page_id is the response; others are revisit records without
payload that refer to it. Groups are found by an aggregate over digests that is reduced before
the shuffle; the pages themselves are shuffled once, by page.

Reading: a file is a stream. It is inflated in pieces of ``PIECE`` bytes; zlib stops at the end of
a member, and what is left over begins the next record. Headers end at the first empty line, the
block is as long as Content-Length says, its digest and that of the payload are compared with the
headers, and a record that is cut short or differs raises an error. One record is held in memory.

Defined cases: null html is an empty payload; a null or unprintable url is written percent-encoded
or left out; a null page_id has its own record ids and comes after all others; rows that repeat a
page_id with equal html are records of their own with equal decisions; an empty table writes no
file and reads as an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import body, stored, table
from stopwise.session import shared_dir

#: Shorter payloads are always written out.
MIN_REVISIT = 1_000
PIECE = 1 << 18
DATE = "2024-01-01T00:00:00Z"


# --- records -------------------------------------------------------------------------------


def record(kind: str, record_id: str, url: str | None, payload: bytes, refers_to: str | None,
           digest: str) -> bytes:
    """One WARC record as a gzip member."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    http.append(b"Content-Length: %d" % len(payload))
    block = b"\r\n".join(http) + b"\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return packer.compress(whole) + packer.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    rest = b""
    while True:
        inflate, out, started = zlib.decompressobj(16 + zlib.MAX_WBITS), [], False
        while not inflate.eof:
            piece = rest or stream.read(PIECE)
            rest = b""
            if not piece:
                if started:
                    raise ValueError("archive ends inside a gzip member")
                return
            started = True
            out.append(inflate.decompress(piece))
        rest = inflate.unused_data
        yield b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises when its framing or a digest is wrong."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{headers.get('warc-record-id')}: length differs from Content-Length")
    if headers["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"{headers['warc-record-id']}: block digest differs")
    _, found, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        if headers["warc-payload-digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            raise ValueError(f"{headers['warc-record-id']}: payload digest differs")
    return headers, payload


# --- Spark jobs ----------------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return "urn:page:none" if page_id is None else f"urn:page:{page_id}"


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.encode(body("html"), "UTF-8")
    seen = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    groups = (
        seen.where(F.col("n") >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .where("copies > 1")
    )
    # Few digests occur twice, so this join is small; one digest with many pages is split by AQE.
    revisits = (
        seen.where(F.col("n") >= min_revisit)
        .join(groups, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
        .distinct()
    )
    whole = pages.select("page_id", "url", body("html").alias("html"), F.sha1(html).alias("digest"))
    same = whole["page_id"].eqNullSafe(revisits["p"]) & (whole["digest"] == revisits["d"])
    return whole.join(revisits, same, "left").select(*whole.columns, "refers_to")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``decide`` below ``folder``; one row per archive: path, n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        path, n, sink = f"{root}/{uuid.uuid4()}.warc.gz", 0, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if sink is None:
                        store.create_dir(root, recursive=True)
                        sink = store.open_output_stream(path, compression=None)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    target = None if r["refers_to"] is None else _urn(r["refers_to"])
                    payload = r["html"].encode()
                    sink.write(record(kind, _urn(r["page_id"]), r["url"], payload, target, r["digest"]))
                    n += 1
        finally:
            if sink is not None:
                sink.close()
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return records.mapInArrow(write, "path string, n_records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives, in their order within each."""
    fields = [
        ("path", pa.string()),
        ("ordinal", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)

        def flush(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
                names=[f for f, _ in fields],
            )

        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size, i = [], 0, -1
                with store.open_input_stream(path, compression=None) as stream:
                    for i, member in enumerate(members(stream)):
                        h, payload = parse(member)
                        rows.append((
                            path, i, h["warc-type"], h["warc-record-id"][1:-1],
                            h.get("warc-refers-to", "<>")[1:-1] or None, h.get("warc-target-uri"),
                            h["warc-payload-digest"].removeprefix("sha1:"), payload,
                        ))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) >= 1_000:
                            yield flush(rows)
                            rows, size = [], 0
                if i + 1 != expected:
                    raise ValueError(f"{path}: {i + 1} records, {expected} were written")
                if rows:
                    yield flush(rows)

    schema = "path string, ordinal long, record_type string, record_id string, refers_to_id string, "
    schema += "target_uri string, payload_digest string, payload binary"
    listed = archives.select("path", "n_records")
    # One archive is one piece of work: they are dealt out to as many tasks as there are.
    return listed.repartition(max(1, listed.count()), "path").mapInArrow(read, schema)


def digest_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per record.

    A revisit has no payload of its own; its length is that of the response it refers to.
    """
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    seen = records.select(
        number(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
        "payload_digest",
        "record_type",
        number(F.col("refers_to_id")).alias("refers_to"),
    )
    seen = stored(seen, "records")
    # Repeated rows of a page are several records of equal digest; one stands for all.
    full = (
        seen.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("own_bytes").alias("full_bytes"))
    )
    return (
        seen.join(full, ["refers_to", "payload_digest"], "left")
        .select(
            "page_id",
            F.when(F.col("record_type") == "response", F.col("own_bytes"))
            .otherwise(F.col("full_bytes"))
            .alias("payload_bytes"),
            "payload_digest",
            "record_type",
            "refers_to",
        )
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    archives = stored(write_archives(decide(pages), folder), "archives")
    return digest_records(read_archives(archives, folder))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h
  FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN top IS NULL OR top = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> p.page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000
"""
