import gzip
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stopwise.params import Params
from stopwise.plans import events, headways, reliability
from stopwise.sinks import exports
from stopwise.sources import raw
from stopwise.streaming import realtime
from tests.conftest import rows, utc

PARAMS = Params(as_of=utc("2025-01-16 12:00:00"), weather_station=None)


def _snapshot(spark, root, minute, stops, with_positions=True):
    feed = utc("2025-01-14 17:00:00") + timedelta(minutes=minute)
    drop = f"{root}/rtd_gtfsrt/snapshot_at={feed:%Y-%m-%dT%H:%M}"
    ups = [
        (feed, f"e{t}", f"T{t}", f"R{t % 2}", f"S{s}", s, 60 * t - 120, None, "SCHEDULED",
         feed + timedelta(seconds=90 * s + t), None, None)
        for t in range(4) for s in stops
    ]
    rows_ = spark.createDataFrame(ups, realtime.UPDATES.schema).coalesce(1)
    exports.write_drop(rows_, drop, realtime.UPDATES.file)
    if with_positions:
        _positions(spark, root, minute)


def _positions(spark, root, minute):
    feed = utc("2025-01-14 17:00:00") + timedelta(minutes=minute)
    drop = f"{root}/rtd_gtfsrt/snapshot_at={feed:%Y-%m-%dT%H:%M}"
    poss = [
        (feed, f"v{t}", f"T{t}", f"R{t % 2}", f"V{t}", "bus", -105.0, 39.7, None, 1.5, feed)
        for t in range(2, 6)
    ]
    rows_ = spark.createDataFrame(poss, realtime.POSITIONS.schema).coalesce(1)
    exports.write_drop(rows_, drop, realtime.POSITIONS.file)


@pytest.fixture(scope="module")
def dims(spark):
    trips = spark.createDataFrame(
        [(f"T{t}", t % 2, "x") for t in range(6)], "trip_id string, direction_id long, trip_headsign string"
    )
    patterns = spark.createDataFrame(
        [],
        "trip_id string, stop_id string, stop_sequence long, route_id string, direction_id long, "
        "arrival_sec long, departure_sec long, service_dates array<date>",
    )
    day = date(2025, 1, 14)
    planned = spark.createDataFrame(
        [(f"R{t}", t, "S2", day, utc("2025-01-14 17:00:00"), 300) for t in (0, 1)],
        "route_id string, direction_id long, stop_id string, service_date_mst date, "
        "sched_arrival_ts_mst timestamp, sch_headway_sec long",
    )
    weather = spark.createDataFrame([(day, True, "heavy")], "service_date_mst date, snow_day boolean, precip_bin string")
    return realtime.Dimensions(trips, patterns, planned, weather)


def _batch(spark, root, dims):
    def read(dataset):
        paths = [r.source_path for r in raw.list_files(spark, root, dataset).collect()]
        return raw.read_files(spark, dataset, paths, strict=True)

    found = events.rt_events(read(realtime.UPDATES), read(realtime.POSITIONS), dims.trips, dims.patterns, PARAMS)
    resolved = events.resolve(found, PARAMS)
    observed = headways.headways_observed(resolved, PARAMS)
    adherence = headways.headway_adherence(observed, dims.scheduled_headways, PARAMS)
    return {
        "events": found,
        "adherence": adherence,
        "stop_hour": reliability.reliability_by_stop_hour(resolved, adherence, PARAMS),
        "route_day": reliability.reliability_by_route_day(resolved, dims.weather_days, PARAMS),
    }


def _assert_same(spark, store, expected):
    for name, frame in expected.items():
        columns = sorted(set(frame.columns) - {"geom", "build_run_at"})
        assert rows(store.read(spark, name), *columns) == rows(frame, *columns), name


def test_stream_equals_batch_with_late_files_and_repeats(spark, folder, dims):
    root, store = f"{folder}/raw", realtime.Store(f"{folder}/store")

    def run():
        stream = realtime.snapshot_files(spark, root, max_files=2)
        realtime.run_stream(stream, store, dims, PARAMS).awaitTermination()

    _snapshot(spark, root, 0, [1, 2], with_positions=False)
    _snapshot(spark, root, 5, [1, 2])
    run()
    before = rows(store.read(spark, "events").groupBy("feed_ts_utc").agg(F.count("vehicle_id")))
    assert len(before) == 2
    # Positions of the first snapshot arrive late, with a new snapshot.
    _positions(spark, root, 0)
    _snapshot(spark, root, 10, [2, 3])
    run()
    expected = _batch(spark, root, dims)
    assert expected["events"].count() == 18
    _assert_same(spark, store, expected)
    assert store.read(spark, "impacts").count() > 0

    # A repeated batch changes nothing.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.csv.gz"
    ).load(f"{root}/rtd_gtfsrt").select("path")
    realtime.process_batch(files, 777, store, dims, PARAMS)
    _assert_same(spark, store, expected)
    listed = raw.manifests(spark, root, realtime.UPDATES)
    assert listed.count() == 3  # the newest manifest of a drop names the file written last
    assert raw.list_files(spark, root, realtime.UPDATES, date(2025, 1, 15)).count() == 0


def test_late_weather_rebuilds_route_days(spark, folder, dims):
    root, store = f"{folder}/raw", realtime.Store(f"{folder}/store")
    _snapshot(spark, root, 0, [1])
    realtime.run_stream(realtime.snapshot_files(spark, root), store, dims, PARAMS).awaitTermination()
    assert rows(store.read(spark, "route_day").select("precip_bin").distinct()) == [("heavy",)]
    dry = dims.weather_days.withColumn("precip_bin", F.lit("none"))
    late = realtime.Dimensions(dims.trips, dims.patterns, dims.scheduled_headways, dry)
    day = date(2025, 1, 14)
    assert realtime.refresh_weather(store, spark, late, PARAMS) == [day]
    assert rows(store.read(spark, "route_day").select("precip_bin").distinct()) == [("none",)]
    # Weather that did not change rebuilds nothing, a day without weather any more counts as dry.
    files = sorted(store.read(spark, "route_day").inputFiles())
    assert realtime.refresh_weather(store, spark, late, PARAMS) == []
    assert sorted(store.read(spark, "route_day").inputFiles()) == files
    gone = realtime.Dimensions(dims.trips, dims.patterns, dims.scheduled_headways, dry.limit(0))
    assert realtime.refresh_weather(store, spark, gone, PARAMS) == [day]
    assert rows(store.read(spark, "route_day").select("precip_bin", "snow_day").distinct()) == [("none", False)]
    assert realtime.refresh_weather(realtime.Store(f"{folder}/empty"), spark, gone, PARAMS) == []


def test_live_windows(spark, folder):
    schema = "route_id string, stop_id string, event_ts_utc timestamp, feed_ts_utc timestamp, delay_sec long"

    def add(name, tuples):
        spark.createDataFrame(tuples, schema).write.mode("append").parquet(f"{folder}/in/{name}")

    t = utc("2025-01-14 17:10:00")
    add("a", [("R1", "S1", t, t, 0), ("R1", "S1", t, t, 400), ("R1", None, t, t, 0)])

    def stream():
        return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")

    def run():
        view = realtime.stop_hour_live(stream(), PARAMS).withColumn("d", F.to_date("window_start"))
        realtime.write_live(view, f"{folder}/out", f"{folder}/cp", ["window_start", "stop_id"], "d").awaitTermination()
        return rows(spark.read.parquet(f"{folder}/out"), "stop_id", "n_events", "pct_on_time")

    assert run() == [("S1", 2, 0.5)]
    add("b", [("R1", "S1", t, t, 0), ("R2", "S2", t, t, 0)])
    assert run() == [("S1", 3, pytest.approx(2 / 3)), ("S2", 1, 1.0)]

    for view, keys, count in (
        (realtime.route_day_live(stream(), PARAMS), ["service_date_mst", "route_id"], 2),
        (realtime.snapshot_windows(stream()), ["window_start"], 1),
    ):
        out = f"{folder}/{keys[0]}"
        day = view.withColumn("d", F.to_date(keys[0]))
        realtime.write_live(day, out, out + "-cp", keys, "d").awaitTermination()
        assert spark.read.parquet(out).count() == count


def test_event_that_moves_to_another_date_leaves_the_old_one(spark, folder, dims):
    store = realtime.Store(f"{folder}/store")
    feed = "2025-01-14T17:00:00.000000Z"

    def batch(batch_id, *events_at):
        path = Path(folder, str(batch_id), realtime.UPDATES.file, "part-0.csv.gz")
        path.parent.mkdir(parents=True)
        with gzip.open(path, "wt") as out:
            print(",".join(realtime.UPDATES.schema.fieldNames()), file=out)
            for at in events_at:
                print(f"{feed},e,T1,R1,S1,1,0,,SCHEDULED,{at}.000000Z,,", file=out)
        df = spark.createDataFrame([(str(path),)], "path string")
        realtime.process_batch(df, batch_id, store, dims, PARAMS)

    batch(0, "2025-01-14T18:00:00")
    assert rows(store.read(spark, "route_day"), F.day("service_date_mst"), "n_events") == [(14, 1)]
    batch(1, "2025-01-15T18:00:00")
    assert rows(store.read(spark, "events"), F.day("event_date_mst")) == [(15,)]
    for mart in ("route_day", "stop_hour"):
        assert rows(store.read(spark, mart), F.day("service_date_mst"), "n_events") == [(15, 1)]


def test_dimensions_are_built_once(spark, dims):
    built = spark.sparkContext.accumulator(0)

    def counted(row):
        built.add(1)
        return row

    plans = {n: spark.createDataFrame(d.rdd.map(counted), d.schema) for n, d in vars(dims).items()}
    kept = realtime.materialized(realtime.Dimensions(**plans))
    once = built.value
    for _ in range(3):
        for n, df in vars(kept).items():
            assert rows(df) == rows(getattr(dims, n))
    assert built.value == once == sum(d.count() for d in vars(dims).values())
    bare = realtime.materialized(realtime.Dimensions(**plans), marts=False)
    assert bare.weather_days is plans["weather_days"] and bare.trips is not plans["trips"]
