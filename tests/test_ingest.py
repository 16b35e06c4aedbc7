"""Raw loads and the stream through deaths between rows and record."""

import os
import shutil
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stopwise.sinks import exports, tables
from stopwise.sources import raw
from stopwise.sources.schemas import DATASETS
from stopwise.streaming import realtime
from tests.conftest import rows, utc
from tests.test_streaming import PARAMS, dims  # noqa: F401

CRASHES = DATASETS["raw_crashes"]
RUN = utc("2025-01-06 01:00:00")


def _drop(spark, root, label, n, start=0, parts=2):
    values = [
        (f"C{start + i}", utc("2025-01-01 10:00:00"), 1 + i % 4, "x", 39.7, -105.0, "r", None, None, i % 2, 0) for i in range(n)
    ]
    frame = spark.createDataFrame(values, CRASHES.schema).repartition(parts)
    return exports.write_drop(frame, f"{root}/{CRASHES.folder}/extract_date={label}", CRASHES.file)


def _paths(spark, root):
    return sorted(r.source_path for r in raw.list_files(spark, root, CRASHES).collect())


def test_load_that_died_is_replaced(spark, folder):
    root, target, ledger = f"{folder}/raw", f"{folder}/table", f"{folder}/ledger"
    _drop(spark, root, "2025-01-01", 7)
    raw.load(spark, root, CRASHES, target, ledger, RUN)
    _drop(spark, root, "2025-01-02", 5, 100)
    _drop(spark, root, "2025-01-03", 3, 200)
    # The second load wrote some of its rows under another day and died.
    late = [p for p in _paths(spark, root) if "2025-01-03" in p]
    raw.write_files(spark, CRASHES, [(p, "old") for p in late], target, 2, RUN)
    assert spark.read.parquet(target).count() == 10
    assert raw.committed(spark, target, ledger, CRASHES).count() == 7
    raw.load(spark, root, CRASHES, target, ledger, RUN)
    table = spark.read.parquet(target)
    assert table.count() == 15 and table.select("crash_id").distinct().count() == 15
    assert table.where("_hash_md5 = 'old'").count() == 0
    assert raw.committed(spark, target, ledger, CRASHES).count() == 15
    counted = table.groupBy("_source_path", "load").agg(F.count(F.lit(1)).alias("rows"))
    plain = F.regexp_replace("_source_path", "^file:/+", "/")
    entries = raw.read_ledger(spark, ledger)
    assert rows(entries.select(plain, "load", "rows")) == rows(counted.select(plain, "load", "rows"))


def test_portions_are_loads_of_their_own(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "FILES", 2)
    root = f"{folder}/raw"
    _drop(spark, root, "2025-01-01", 50, parts=5)
    raw.load(spark, root, CRASHES, f"{folder}/t", f"{folder}/l", RUN)
    entries = raw.read_ledger(spark, f"{folder}/l")
    assert rows(entries.groupBy("load").agg(F.count("*"))) == [(1, 2), (2, 2), (3, 1)]
    assert entries.agg(F.sum("rows")).first()[0] == spark.read.parquet(f"{folder}/t").count() == 50
    # Histograms of several portions in one write.
    many = spark.range(70).select(F.col("id"), (F.col("id") % 7).cast("int").alias("_file"), F.lit("d").alias("day"))
    assert tables.write_load(many, f"{folder}/m", "load", 1, "day", ("id",), 7) == [10] * 7
    with pytest.raises(ValueError, match="known files"):
        tables.write_load(many.withColumn("_file", F.lit(None).cast("int")), f"{folder}/m", "load", 1, "day")


def test_hashes_are_kept_and_unchanged_files_not_read_again(spark, folder):
    root, store = f"{folder}/raw", f"{folder}/hashes"
    _drop(spark, root, "2025-01-01", 7)

    def hashes():
        found = raw.file_hashes(raw.list_files(spark, root, CRASHES), None, raw.contents(spark, root, CRASHES), store)
        return dict(rows(found, F.regexp_extract("source_path", "(extract_date=.*)$", 1), "hash_md5"))

    first = hashes()
    assert len(first) == 2 and all(first.values())
    # Other bytes under the same size and time: whoever reads them would see another hash.
    for path in Path(root).rglob("part-*.csv.gz"):
        stat = path.stat()
        crc = path.with_name(f".{path.name}.crc")
        crc.unlink(missing_ok=True)
        path.write_bytes(b"\0" * stat.st_size)
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    _drop(spark, root, "2025-01-02", 4, 100, parts=1)
    second = hashes()
    assert {k: second[k] for k in first} == first and len(second) == 3
    # A changed time makes a file a new one.
    for path in Path(root).rglob("extract_date=2025-01-01/*/part-*.csv.gz"):
        os.utime(path)
    third = hashes()
    assert all(third[k] != first[k] for k in first)
    assert spark.read.parquet(store).count() == 5


def _feed_rows(spark, minute, n=4):
    feed = utc(f"2025-01-14 17:{minute:02}:00")
    values = [(feed, f"e{i}", f"T{i}", "R1", "S1", 1, 60, None, "SCHEDULED", feed, None, None) for i in range(n)]
    return spark.createDataFrame(values, realtime.UPDATES.schema).coalesce(1)


def _ledger_equals_rows(spark, store):
    counted = store.read(spark, "raw_updates").groupBy("batch", "_source_path", "_hash_md5").agg(F.count("*").alias("rows"))
    plain = F.regexp_replace(F.url_decode("_source_path"), "^file:/+", "/")
    entries = store.read(spark, "ledger").where("table = 'raw_updates'")
    assert rows(entries, "batch", plain, "_hash_md5", "rows") == rows(counted, "batch", plain, "_hash_md5", "rows")
    return entries


def test_folder_without_manifest_waits(spark, folder, dims):  # noqa: F811
    root, store = f"{folder}/raw", realtime.Store(f"{folder}/store")

    def run():
        stream = realtime.snapshot_manifests(spark, root)
        realtime.run_stream(stream, store, dims, PARAMS, realtime.read_manifests).awaitTermination()
        return rows(store.read(spark, "raw_updates").groupBy(F.minute("feed_ts_utc")).agg(F.count("*")))

    drops = [f"{root}/rtd_gtfsrt/snapshot_at=2025-01-14T17:{minute:02}" for minute in (0, 5)]
    exports.write_drop(_feed_rows(spark, 0), drops[0], realtime.UPDATES.file)
    waiting = exports.write_parts(_feed_rows(spark, 5, 3), drops[1], realtime.UPDATES.file)
    assert run() == [(0, 4)]
    exports.write_manifest(spark, drops[1], waiting)
    assert run() == [(0, 4), (5, 3)]
    assert run() == [(0, 4), (5, 3)]
    entries = _ledger_equals_rows(spark, store)
    assert rows(entries, "batch", raw.extract_date("_source_path"), "rows") == [(0, date(2025, 1, 14), 4), (1, date(2025, 1, 14), 3)]
    assert store.read(spark, "raw_updates").where("_hash_md5 is null or _ingested_at is null").count() == 0


@pytest.mark.parametrize("step", ["commit_load", "resolve_snapshots"])
def test_batch_killed_after_its_rows_is_written_once(spark, folder, dims, monkeypatch, step):  # noqa: F811
    """Killed before or after the record: the repeated batch leaves rows and ledger equal."""
    root, store = f"{folder}/raw", realtime.Store(f"{folder}/store")
    exports.write_drop(_feed_rows(spark, 0), f"{root}/rtd_gtfsrt/snapshot_at=2025-01-14T17:00", realtime.UPDATES.file)

    def run():
        stream = realtime.snapshot_manifests(spark, root)
        realtime.run_stream(stream, store, dims, PARAMS, realtime.read_manifests).awaitTermination()

    def dies(*args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(realtime.tables if step == "commit_load" else realtime, step, dies)
        with pytest.raises(Exception, match="killed"):
            run()
    assert store.read(spark, "raw_updates").count() == 4
    run()
    assert _ledger_equals_rows(spark, store).agg(F.sum("rows")).first()[0] == 4
    assert store.read(spark, "events").count() == 4


def test_manifest_that_is_not_json_stops_the_stream(spark, folder, dims):  # noqa: F811
    root, store = f"{folder}/raw", realtime.Store(f"{folder}/store")
    drop = Path(root, "rtd_gtfsrt", "snapshot_at=2025-01-14T17:00")
    drop.mkdir(parents=True)
    Path(drop, "manifest.json").write_text('{"files": {')
    stream = realtime.snapshot_manifests(spark, root)
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        realtime.run_stream(stream, store, dims, PARAMS, realtime.read_manifests).awaitTermination()
    shutil.copy(drop / "manifest.json", drop / "copy")
    assert store.read(spark, "ledger") is None
