from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stopwise.plans import checks, query
from stopwise.sinks import exports, tables
from stopwise.sources import raw
from stopwise.sources.schemas import DATASETS, LEDGER
from tests.conftest import ordered, rows, utc

WEATHER = DATASETS["raw_weather_daily"]
CRASHES = DATASETS["raw_crashes"]


def _crash_rows(spark, n, start=0):
    return spark.createDataFrame(
        [(f"C{i}", utc("2025-01-01 10:00:00") + timedelta(days=i % 3), 1, 'a "quoted", text\nline', 39.7, -105.0,
          None, None, None, 0, 1) for i in range(start, start + n)],
        CRASHES.schema,
    )


def _drop(spark, root, label, n, start=0):
    folder = f"{root}/{CRASHES.folder}/extract_date={label}"
    return exports.write_drop(_crash_rows(spark, n, start).repartition(2), folder, CRASHES.file)


def test_drop_load_ledger_and_provenance(spark, folder):
    root, target, ledger = f"{folder}/raw", f"{folder}/table", f"{folder}/ledger"
    manifest = _drop(spark, root, "2025-01-01", 7)
    assert manifest["row_count"] == 7 and all(f["hash_md5"] for f in manifest["files"].values())
    _drop(spark, root, "2025-01-05", 5, 100)
    run = utc("2025-01-06 01:00:00")

    files = raw.list_files(spark, root, CRASHES)
    listed = raw.manifests(spark, root, CRASHES)
    read = raw.contents(spark, root, CRASHES)
    hashed = raw.file_hashes(files, listed, read, f"{folder}/hashes")
    assert raw.tables.read_table(spark, f"{folder}/hashes") is None
    assert rows(hashed, "hash_md5") == rows(raw.file_hashes(files, None, read, f"{folder}/hashes"), "hash_md5")
    only = raw.list_files(spark, root, CRASHES, date(2025, 1, 5), date(2025, 1, 5))
    assert rows(only.select("extract_date").distinct()) == [(date(2025, 1, 5),)]

    plan = raw.load(spark, root, CRASHES, target, ledger, run, start=date(2025, 1, 1), end=date(2025, 1, 3))
    assert rows(plan.select("status").distinct()) == [("LOAD",)]
    plan = raw.load(spark, root, CRASHES, target, ledger, run + timedelta(hours=1))
    assert rows(plan.groupBy("status", "extract_date").agg(F.sum(F.lit(1)))) == ordered(
        [("DONE", date(2025, 1, 1), 2), ("LOAD", date(2025, 1, 5), 2)]
    )
    again = raw.load(spark, root, CRASHES, target, ledger, run + timedelta(hours=2))
    assert rows(again.select("status").distinct()) == [("DONE",)]

    table = spark.read.parquet(target)
    assert table.count() == 12
    assert rows(table.select("severity_text").distinct()) == [('a "quoted", text\nline',)]
    assert rows(table.select("_extract_date").distinct()) == [(date(2025, 1, 1),), (date(2025, 1, 5),)]
    assert rows(table.select("event_date").distinct())[0] == (date(2025, 1, 1),)
    assert table.where("_hash_md5 is null or _source_path is null or _ingested_at is null").count() == 0
    entries = spark.read.parquet(ledger)
    assert entries.agg(F.sum("rows")).first()[0] == 12
    assert raw.ledger_latest(entries).count() == 4
    assert rows(raw.source_freshness(table, run + timedelta(days=3)), "grade") == [("warn",)]

    marked = table.selectExpr(
        "regexp_extract(_source_path, '(.*/extract_date=[^/]+)/', 1) as _drop",
        "regexp_extract(_source_path, 'extract_date=[^/]+/(.+)$', 1) as _name",
    ).withColumn("_drop", F.regexp_replace("_drop", "^file:/+", "/"))
    listed = listed.withColumn("drop", F.regexp_replace("drop", "^file:/+", "/"))
    assert checks.manifest_mismatch(marked, listed).count() == 0
    assert checks.manifest_mismatch(marked.limit(11), listed).count() == 1


def test_file_cap_loads_the_rest_later(spark, folder):
    root = f"{folder}/raw"
    _drop(spark, root, "2025-01-01", 4)
    run = utc("2025-01-06 01:00:00")
    for i, expected in enumerate((1, 2)):
        raw.load(spark, root, CRASHES, f"{folder}/t", f"{folder}/l", run + timedelta(hours=i), max_files=1)
        assert spark.read.parquet(f"{folder}/l").count() == expected
    assert spark.read.parquet(f"{folder}/t").count() == 4


def test_extract_dates_and_plan(spark):
    paths = ["x/extract_date=2025-01-02/f", "x/snapshot_at=2025-01-03T00:05/f", "x/extract_date=oops/f", "x/f"]
    df = spark.createDataFrame([(p, "h") for p in paths], "source_path string, hash_md5 string")
    df = df.withColumn("extract_date", raw.extract_date("source_path"))
    assert [r.extract_date for r in df.collect()] == [date(2025, 1, 2), date(2025, 1, 3), None, None]
    ledger = spark.createDataFrame([(paths[1], "h", None, "t", 1), (paths[3], "other", None, "t", 1)], LEDGER)
    plan = raw.load_plan(df, ledger, date(2025, 1, 3))
    assert rows(plan, "source_path", "status") == ordered(
        [(paths[0], "SKIP"), (paths[1], "DONE"), (paths[2], "LOAD"), (paths[3], "LOAD")]
    )
    glob = raw.drop_glob("/r", DATASETS["raw_gtfsrt_trip_updates"], date(2025, 1, 1), date(2025, 1, 2))
    assert glob == "/r/rtd_gtfsrt/snapshot_at={2025-01-01*,2025-01-02*}"


DAYS = [date(2025, 1, d) for d in (1, 2, 3)]


def _table(spark, tuples):
    return spark.createDataFrame(tuples, "k int, v string, day date")


def test_upsert_updates_inserts_and_keeps_other_partitions(spark, folder):
    path = f"{folder}/t"
    tables.upsert(_table(spark, [(1, "a", DAYS[0]), (2, "a", DAYS[0]), (3, "a", DAYS[1])]), path, ["k"], "day")
    tables.upsert(_table(spark, [(2, "b", DAYS[0]), (4, "b", DAYS[0])]), path, ["k"], "day")
    expected = [(1, "a", DAYS[0]), (2, "b", DAYS[0]), (3, "a", DAYS[1]), (4, "b", DAYS[0])]
    assert rows(tables.read_table(spark, path), "k", "v", "day") == ordered(expected)
    tables.upsert(_table(spark, [(2, "b", DAYS[0]), (4, "b", DAYS[0])]), path, ["k"], "day")
    assert rows(tables.read_table(spark, path), "k", "v", "day") == ordered(expected)
    # Key 3 moves to another date and empties its old partition.
    tables.upsert(_table(spark, [(3, "c", DAYS[2])]), path, ["k"], "day", lookback="day >= date '2025-01-01'")
    assert rows(tables.read_table(spark, path), "k", "v", "day") == ordered(
        [(1, "a", DAYS[0]), (2, "b", DAYS[0]), (3, "c", DAYS[2]), (4, "b", DAYS[0])]
    )


def test_append_and_partition_overwrite(spark, folder):
    path = f"{folder}/t"
    tables.append(_table(spark, [(1, "a", DAYS[0])]), path, "day", ("k",))
    tables.append(_table(spark, [(1, "a", DAYS[0]), (2, "a", DAYS[1])]), path, "day", ("k",))
    assert spark.read.parquet(path).count() == 3
    tables.overwrite_partitions(_table(spark, [(9, "z", DAYS[0])]), path, "day")
    assert rows(spark.read.parquet(path), "k") == [(2,), (9,)]
    tables.overwrite(_table(spark, [(5, "n", DAYS[2])]), path)
    assert rows(spark.read.parquet(path), "k") == [(5,)]


def test_replace_relation_switches_kind(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for hot in (False, True, False, True):
        tables.replace_relation(df, "mart_switch", hot)
        assert spark.table("mart_switch").count() == 1
    spark.sql("drop table mart_switch")


def _mart(spark, dates, n=1):
    return spark.createDataFrame([(d, i) for d in dates for i in range(n)], "service_date_mst date, v int")


def test_partitioned_export(spark, folder):
    state, root = f"{folder}/state", f"{folder}/marts"
    exports.write_state(spark, state, "m", date(2025, 1, 2), utc("2025-01-02 01:00:00"))
    exports.write_state(spark, state, "other", None, None)
    mart = _mart(spark, [date(2025, 1, 2), date(2025, 1, 3), date(2025, 1, 4), None])
    done = exports.export_partitioned(mart, "m", root, state, utc("2025-01-05 01:00:00"), since=date(2025, 1, 1))
    assert done == [date(2025, 1, 3), date(2025, 1, 4)]
    assert exports.export_partitioned(mart, "m", root, state, utc("2025-01-05 02:00:00")) == []
    kept = exports.read_state(spark, state)
    assert rows(kept, "mart_name", "last_service_date") == [("m", date(2025, 1, 4)), ("other", None)]
    assert rows(spark.read.parquet(f"{root}/m"), "run_date") == [(date(2025, 1, 3),), (date(2025, 1, 4),)]
    redo = exports.new_partitions(mart, date(2025, 1, 4), reexport_days=2)
    assert rows(redo) == [(date(2025, 1, 3),), (date(2025, 1, 4),)]


def test_snapshot_export_once_per_day_and_scans(spark, folder):
    state, root = f"{folder}/state", f"{folder}/marts"
    mart = spark.range(5)
    times = [utc("2025-01-20 01:00:00"), utc("2025-01-20 23:00:00"), utc("2025-01-21 00:10:00"), utc("2025-01-22 03:00:00")]
    assert [exports.export_snapshot(mart, "s", root, state, t) for t in times] == [True, False, True, True]
    assert raw.mart_scan(spark, root, "s", max_age_days=None).count() == 15
    latest = raw.mart_scan(spark, root, "s", latest_only=True)
    assert latest.count() == 5 and latest.first().run_date == date(2025, 1, 22)
    young = raw.mart_scan(spark, root, "s", max_age_days=1, today=date(2025, 1, 22))
    assert young.count() == 10
    assert raw.mart_scan(spark, root, "s", max_age_days=1, today=date(2026, 1, 1)).count() == 15
    found = exports.sync_state({"s": spark.read.parquet(f"{root}/s")}, times[0], {"marts": {"old": "2024-01-01"}})
    assert found["marts"] == {"old": "2024-01-01", "s": "2025-01-22"}
    assert found["synced_at_utc"] == "2025-01-20T01:00:00Z"


def test_freshest_state_over_two_stores(spark):
    a = spark.createDataFrame([("m", date(2025, 1, 1), None), ("n", date(2025, 1, 1), utc("2025-01-01 00:00:00"))],
                              "mart_name string, last_service_date date, last_run_ts timestamp")
    b = spark.createDataFrame([("m", date(2025, 1, 2), utc("2020-01-01 00:00:00"))], a.schema)
    assert rows(exports.freshest_state(a, b), "mart_name", "last_service_date") == [
        ("m", date(2025, 1, 2)), ("n", date(2025, 1, 1)),
    ]


def test_mart_query(spark, folder):
    route_day = spark.createDataFrame(
        [("R1", date(2025, 1, d), "none", 0.5) for d in range(1, 11)] + [("R2", date(2025, 1, 5), "mod", 0.1)],
        "route_id string, service_date_mst date, precip_bin string, pct_on_time double",
    )
    stops = spark.createDataFrame([("A1", 3)], "stop_id string, crash_250m_cnt long")
    marts = {"mart_reliability_by_route_day": route_day, "mart_crash_proximity_by_stop": stops, "secret": stops}
    span = query.Filters(date(2025, 1, 2), date(2025, 1, 6))
    name = "mart_reliability_by_route_day"
    assert query.mart_query(marts, name, span).count() == 6
    assert query.mart_query(marts, name, span, limit=2).count() == 2
    assert query.mart_query(marts, name, replace(span, routes=["R2"], weather=["mod"], stop_id="x")).count() == 1
    assert query.mart_query(marts, "mart_crash_proximity_by_stop", query.Filters(stop_id=" a1 ")).count() == 1
    with pytest.raises(ValueError, match="date range"):
        query.mart_query(marts, name)
    with pytest.raises(ValueError, match="secret"):
        query.mart_query(marts, "secret")
    assert query.preview(marts, name, 100).count() == 11
    shown, total = query.display(route_day, 3)
    assert shown.count() == 3 and total.first().total_rows == 11
    rich = query.enrich(
        stops.withColumn("lat", F.lit(1.0)),
        spark.createDataFrame([("A1", "Main", 9.0, 8.0)], "stop_id string, stop_name string, lat double, lon double"),
        spark.createDataFrame([], "route_id string, route_name string, route_long_name string"),
    )
    assert rows(rich, "stop_id", "stop_name", "lat", "lon") == [("A1", "Main", 1.0, 8.0)]
    out = query.export_rows(route_day, "service_date_mst", date(2025, 1, 1), date(2025, 1, 2))
    exports.export_csv(out, f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 2
    with pytest.raises(ValueError, match="limit"):
        query.export_rows(route_day, limit=0)
    with pytest.raises(ValueError, match="before"):
        query.export_rows(route_day, "service_date_mst", date(2025, 1, 2), date(2025, 1, 1))


def test_checks(spark):
    df = spark.createDataFrame([(1, 5.0), (1, None), (None, 10.0)], "k int, v double")
    assert checks.not_null(df, "k").count() == 1
    assert rows(checks.unique(df, ["k"]), "k", "n") == [(1, 2)]
    assert checks.accepted_range(df, "v", 5, 10).count() == 0
    assert rows(checks.accepted_range(df, "v", 5, 10, exclusive_low=True), "value") == [(5.0,)]
    parent = spark.createDataFrame([(2,)], "id int")
    assert rows(checks.relationship(df, "k", parent, "id")) == [(1,), (1,)]
    assert rows(checks.duplicate_profile(df, ["k"])) == [(2, 1, 2, 3)]
    grades = spark.createDataFrame([(n,) for n in (280, 279, 80, 79)], "n int")
    assert [r[0] for r in grades.select(checks.grade(F.col("n"), 280, 200, 80)).collect()] == [
        "PASS", "WARN", "WARN", "FAIL",
    ]
    contract = checks.column_contract(df.withColumn("e", F.lit(None)), ["k", "v", "e", "gone"], types={"k": "bigint"})
    assert rows(contract) == ordered([("missing", "gone"), ("type", "k"), ("all null", "e")])
