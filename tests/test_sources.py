from datetime import date

import pytest
from pyspark.sql import functions as F

from stopwise.sources import acs, crashes, gtfs, raw, realtime, sidewalks, tracts, weather
from stopwise.sources.schemas import DATASETS
from tests.conftest import ordered, rows, utc


def _json(spark, folder, text, ddl):
    path = f"{folder}/in.json"
    with open(path, "w") as out:
        out.write(text.replace("\n", ""))
    return spark.read.schema(ddl).json(path)


def test_trip_updates(spark, folder):
    feed = _json(
        spark, folder,
        """{"captured_at": "2025-01-14T17:03:40Z", "entity": [
        {"id": "1", "trip_update": {"trip": {"trip_id": "T1", "route_id": "R1"}, "timestamp": 1736870000,
         "stop_time_update": [
          {"stop_id": "S1", "stop_sequence": 1, "arrival": {"delay": -3601, "time": 1736871000}},
          {"stop_id": "", "departure": {"delay": 7201, "time": 1736872000}},
          {"stop_id": "S3", "arrival": {"delay": 5}}]}},
        {"id": "", "trip_update": {"trip": {"trip_id": "", "route_id": ""}, "timestamp": 0,
         "stop_time_update": [{"stop_id": "S4"}]}},
        {"id": "3", "vehicle": {}}]}""",
        realtime.TRIP_FEED,
    )
    found = realtime.trip_updates(feed)
    assert rows(found, "entity_id", "trip_id", "stop_id", F.unix_seconds("event_ts_utc"), "arrival_delay_sec") == ordered(
        [("1", "T1", "S1", 1736871000, -3601), ("1", "T1", None, 1736872000, None),
         ("1", "T1", "S3", 1736870000, 5), (None, None, "S4", int(utc("2025-01-14 17:03:00").timestamp()), None)]
    )
    assert rows(found.select("schedule_relationship").distinct()) == [("SCHEDULED",)]
    assert realtime.delay_outliers(found).first()[0] == 2
    assert realtime.trip_updates(feed, " R1 ,").count() == 3
    assert realtime.trip_updates(feed, " , ").count() == 4


def test_vehicle_positions(spark, folder):
    feed = _json(
        spark, folder,
        """{"captured_at": "2025-01-14T17:03:40Z", "entity": [
        {"id": "1", "vehicle": {"trip": {"trip_id": "T1"}, "vehicle": {"id": "B", "label": ""},
         "position": {"longitude": -105.0, "latitude": 39.7}, "timestamp": 1736871000}},
        {"id": "2", "vehicle": {"position": {"longitude": -100.0, "latitude": 39.7}}},
        {"id": "3", "vehicle": {"trip": {"trip_id": "T3"}}}, {"id": "4"}]}""",
        realtime.VEHICLE_FEED,
    )
    found = realtime.vehicle_positions(feed)
    assert rows(found, "entity_id", "vehicle_label", F.unix_seconds("event_ts_utc")) == ordered(
        [("1", None, 1736871000), ("2", None, 1736874180), ("3", None, 1736874180)]
    )
    assert tuple(realtime.position_quality(found).first()) == (50.0, 1)
    assert realtime.position_quality(found.limit(0)).first().in_bbox_pct is None


def test_crashes(spark):
    feed = spark.createDataFrame(
        [
            ({"incident_id": "a", "first_occurrence_date": "1736871000999",
              "top_traffic_accident_offense": "TRAF - ACCIDENT - SBI", "incident_address": " X / Y / Z ",
              "geo_lat": "39.7", "POINT_Y": "39.8", "POINT_X": "-105.1", "bicycle_ind": "2",
              "FATALITIES": "0"}, {"x": 0.0, "y": 0.0}),
            ({"incident_id": "b", "first_occurrence_date": "x", "incident_address": "A & B",
              "SERIOUSLY_INJURED": "1"}, {"x": -11688546.5, "y": 4825922.8}),
            ({"incident_id": "c", "incident_address": "  "}, None),
        ],
        crashes.CRASH_FEATURE,
    )
    found = {r.crash_id: r for r in crashes.crashes(feed).collect()}
    assert set(found) == {"a", "b"}
    a, b = found["a"], found["b"]
    assert (a.severity, a.severity_text, a.lat, a.lon) == (3, "serious_injury", 39.8, -105.1)
    assert (a.roadway_name, a.on_route, a.off_route, a.bike_involved) == ("X / Y / Z", "X", "Y / Z", 1)
    assert a.event_ts_utc == utc("2025-01-14 16:10:00").replace(tzinfo=None)
    assert (b.severity, b.event_ts_utc, b.on_route, b.off_route) == (3, None, "A", "B")
    assert b.lon == pytest.approx(-105.0, abs=1e-4) and b.lat == pytest.approx(39.72, abs=0.05)
    q = crashes.crash_quality(feed).first()
    assert (q.total, q.dropped_no_location, q.timestamp_success, q.bbox_total, q.bbox_in) == (3, 1, 1, 2, 2)
    assert q.timestamp_success_pct == 50.0


def test_sidewalks(spark):
    feed = spark.createDataFrame(
        [
            ({"OBJECTID": "7", "FACILITYID": " F1 ", "SIDEWALKTYPE": None, "BUILTYEAR": "x"},
             {"paths": [[[-105.0, 39.7], [-105.0, 39.701]], [[-105.0, 39.702]]]}),
            ({"OBJECTID": "8", "FACILITYID": "", "BUILTYEAR": "1990"}, {"paths": [[[-105.0, 39.7]]]}),
            ({"OBJECTID": "9"}, {"paths": []}),
            ({"OBJECTID": "10"}, None),
        ],
        sidewalks.SIDEWALK_FEATURE,
    )
    found = sidewalks.sidewalks(feed)
    by_id = {r.sidewalk_id: r for r in found.collect()}
    assert set(by_id) == {"f1", "8"}
    assert by_id["f1"].length_m == pytest.approx(222.0, abs=0.3)
    assert by_id["f1"].lat_end == 39.702 and by_id["f1"].centroid_lat == pytest.approx(39.701)
    assert (by_id["8"].length_m, by_id["8"].year_built, by_id["f1"]["class"]) == (0.0, "1990", "")
    q = sidewalks.network_quality(feed, found).first()
    assert (q.segment_count, q.positive_length_pct) == (4, 25.0)


def test_tract_rings(spark):
    outer = [[0.0, 0.0], [0.0, 4.0], [4.0, 4.0], [4.0, 0.0], [0.0, 0.0]]  # clockwise
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]
    feed = spark.createDataFrame(
        [
            ({"GEOID": "1", "NAME": "one"}, {"rings": [outer, hole]}),
            ({"GEOID20": "2", "STATEFP": "08", "COUNTYFP": "005"}, {"rings": [outer[::-1]]}),
            ({"GEOID": "3"}, {"rings": [outer, outer, hole[:3]]}),
            ({"GEOID": "4"}, {"rings": [hole[:3]]}), ({"GEOID": "5"}, None), ({"NAME": "x"}, {"rings": [outer]}),
        ],
        tracts.TRACT_FEATURE,
    )
    found = {r.geoid: r for r in tracts.tracts(feed).collect()}
    assert set(found) == {"1", "2", "3"}
    ccw, cw = str(outer[::-1]).replace(" ", ""), str(hole[::-1]).replace(" ", "")
    assert found["1"].geometry_geojson == f'{{"type":"Polygon","coordinates":[{ccw},{cw}]}}'
    assert found["2"].geometry_geojson == f'{{"type":"Polygon","coordinates":[{ccw}]}}'
    assert found["3"].geometry_geojson == f'{{"type":"MultiPolygon","coordinates":[[{ccw}],[{ccw}]]}}'
    assert found["2"].name == "2"
    assert tuple(tracts.tract_quality(feed).first()) == (3, 2)
    assert tracts.county_features(feed).count() == 5


def test_weather(spark):
    seen = spark.createDataFrame(
        [("2025-01-01T00:00:00", "W", "PRCP", 0.0), ("2025-01-01", "W", "TMIN", -20.0),
         ("2025-01-01", "W", "TMAX", 150.0), ("2025-01-02", "W", "PRCP", 5.0), ("2025-01-02", "W", "SNOW", 0.99),
         ("2025-01-03", "W", "PRCP", 5.01), ("2025-01-03", "W", "SNOW", 1.0), ("2025-01-04", "W", "PRCP", 20.0),
         ("2025-01-05", "W", "PRCP", 20.01), ("oops", "W", "PRCP", 1.0), ("2025-01-05", "W", "AWND", 999.0)],
        "date string, station string, datatype string, value double",
    )
    found = weather.daily_weather(weather.widen(seen), date(2025, 1, 1), date(2025, 1, 6))
    assert rows(found, F.day("date"), "station", "precip_bin", "snow_day", "tavg_c") == ordered(
        [(1, "W", "none", None, -2.5), (2, "W", "light", 0, None), (3, "W", "mod", 1, None),
         (4, "W", "mod", None, None), (5, "W", "heavy", None, None), (6, "USW00023062", None, None, None)]
    )
    assert weather.missing_rates(found, ["precip_bin"]).first()[0] == pytest.approx(1 / 6)


def test_demographics_and_gtfs(spark):
    code = acs.VARIABLES
    row = {"NAME": "t", "state": "08", "county": "031", "tract": "1", "block group": "2"}
    row |= {c: "0" for c in code.values()} | {code["hh_total"]: "3", code["hh_no_vehicle"]: "1", code["pop_total"]: "-"}
    df = spark.createDataFrame([row])
    found = acs.demographics(df, 2023, "bg").first()
    assert (found.geoid, found.pct_hh_no_vehicle, found.pct_transit_commute, found.pop_total) == (
        "15000US0803112", 0.3333, None, None,
    )
    assert tuple(acs.denominator_coverage(acs.demographics(df, 2023)).first()) == (1.0, 0.0, 0.0)
    stops = spark.createDataFrame([("1", "n", 1.0, 2.0)], "stop_id string, ` stop_name` string, stop_lat double, stop_lon double")
    checked = gtfs.validate({"stops.txt": stops, "calendar.txt": stops.limit(0)})
    assert {r.file: (r.row_count, r.valid) for r in checked.collect()} == {
        "stops.txt": (1, True), "calendar.txt": (0, True), "routes.txt": (0, False),
        "trips.txt": (0, False), "stop_times.txt": (0, False),
    }


def test_schedule_text_scan_prunes_to_the_newest_extract(spark, folder):
    import os

    times = DATASETS["raw_gtfs_stop_times"]
    for day, rows_ in (("2025-01-01", "T0,08:00:00,,S1,1\n"), ("2025-01-08", "T1,25:00:00,,S1,1\nT1,,,S2,2\n")):
        drop = f"{folder}/raw/rtd_gtfs/extract_date={day}/gtfs"
        os.makedirs(drop)
        with open(f"{drop}/stop_times.txt", "w") as out:
            names = times.schema.fieldNames()
            out.write(",".join(names) + "\n" + "".join(
                line + "," * (len(names) - 5) + "\n" for line in rows_.splitlines()
            ))
    run = utc("2025-01-09 00:00:00")
    raw.load(spark, f"{folder}/raw", times, f"{folder}/t", f"{folder}/l", run)
    from stopwise.plans import staging

    table = spark.read.parquet(f"{folder}/t")
    assert table.count() == 3
    staged = staging.stop_times(table)
    assert rows(staged, "trip_id", "stop_id", "arr_hour_gtfs") == [("T1", "S1", 25), ("T1", "S2", None)]
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_extract_date" in plan


def test_length_projects_a_vertex_once(spark):
    length = sidewalks.projected_length("v")
    df = spark.createDataFrame(
        [([[-105.0, 39.7], [-104.99, 39.7], [-104.99, 39.71]],), ([[-105.0, 39.7]],), ([],), (None,),
         ([[-105.0, 39.7], [None, 39.7]],)],
        "v array<array<double>>",
    )
    e, n = sidewalks.geo.utm13(F.col("p")[0], F.col("p")[1])
    ends = [tuple(r) for r in df.limit(1).select(F.explode("v").alias("p")).select(e, n).collect()]
    legs = sum(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in zip(ends, ends[1:]))
    found = [r[0] for r in df.select(length).collect()]
    assert found[0] == pytest.approx(legs, rel=1e-12)
    assert found[1:] == [0.0, 0.0, None, None]
    # Functions over arrays are interpreted: what is written twice is computed twice.
    text = df.select(length.alias("m"))._jdf.queryExecution().analyzed().toString().lower()
    assert text.count("atan2") == 1 and text.count("sinh") == 4
