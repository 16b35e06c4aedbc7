import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.plans import places, query, staging
from tests.conftest import ordered, rows, utc

LON, LAT = -105.0, 39.7


def north(meters):
    return LAT + meters / geo.METERS_PER_DEGREE


def _stops(spark, spots):
    raw = spark.createDataFrame(
        [(n, n, lat, lon, "1") for n, (lon, lat) in spots.items()],
        "stop_id string, stop_name string, stop_lat double, stop_lon double, "
        "wheelchair_boarding string",
    )
    return staging.stops(raw)


def _crashes(spark, found):
    df = spark.createDataFrame(found, "crash_id string, event_ts_utc timestamp, severity long, lat double")
    return df.withColumn("geom", geo.point(f"{LON}D", "lat"))


def test_crash_radii_and_window(spark, params):
    newest = utc("2025-01-14 23:59:59")
    first = utc("2024-01-15 00:00:00")  # 365 days before the newest date
    found = [
        ("a", newest, 4, north(99)), ("b", first, 3, north(101)), ("c", newest, 1, north(249)),
        ("d", newest, 4, north(251)), ("e", first - timedelta(seconds=1), 4, north(10)),
        ("f", newest, 2, north(99)),
    ]
    stops = _stops(spark, {"S": (LON, LAT), "twin": (LON, LAT), "far": (LON + 1, LAT), "lost": (None, LAT)})
    mart = {r.stop_id: r for r in places.crash_proximity_by_stop(stops, _crashes(spark, found), params).collect()}
    assert len(mart) == 4
    for name in ("S", "twin"):
        r = mart[name]
        assert (r.crash_100m_cnt, r.severe_100m_cnt, r.fatal_100m_cnt) == (2, 1, 1)
        assert (r.crash_250m_cnt, r.severe_250m_cnt, r.fatal_250m_cnt) == (4, 2, 1)
        assert r.as_of_date == date(2025, 1, 14) and r.window_days == 365
    assert mart["far"].crash_250m_cnt == mart["lost"].crash_250m_cnt == 0
    pairs = places.crash_pairs(stops, _crashes(spark, found), params)
    assert pairs.count() == 8


def test_no_crashes(spark, params):
    mart = places.crash_proximity_by_stop(_stops(spark, {"S": (LON, LAT)}), _crashes(spark, []), params).first()
    assert mart.as_of_date is None and mart.crash_250m_cnt == 0


def _sidewalks(spark, chords, day):
    return spark.createDataFrame(
        [(f"K{i}", *c, day) for i, c in enumerate(chords)],
        "sidewalk_id string, lon_start double, lat_start double, lon_end double, lat_end double, "
        "_extract_date date",
    ).selectExpr(
        "*", "'x' as class", "'x' as status", "'x' as material", "'1' as year_built", "1D as length_m",
        "lon_start as centroid_lon", "lat_start as centroid_lat",
    )


def test_access_counts_each_extract_only_on_request(spark, params):
    chord = (LON, north(-50), LON, north(50))
    raw = _sidewalks(spark, [chord], date(2025, 1, 1)).union(
        _sidewalks(spark, [chord, chord, (LON, LAT, LON, LAT)], date(2025, 1, 2))
    )
    stops = _stops(spark, {"S": (LON, LAT), "none": (LON + 1, LAT)})
    for every, copies in ((False, 2), (True, 3)):
        mart = places.access_score_by_stop(stops, staging.sidewalks(raw, every), params)
        found = {r.stop_id: r for r in mart.collect()}
        assert found["S"].sidewalk_len_m_within_200m == pytest.approx(100 * copies, abs=1e-3)
        assert (found["S"].access_score_0_100, found["none"].access_score_0_100) == (100.0, 0.0)
        assert found["S"].buffer_m == 200


def _tracts(spark, squares):
    def text(x, y, w):
        ring = [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
        return str({"type": "Polygon", "coordinates": [ring]}).replace("'", '"')

    raw = spark.createDataFrame(
        [(g, g, 1.0, 0.0, text(*s), utc("2025-01-01 00:00:00")) for g, s in squares.items()],
        "geoid string, name string, aland_m2 double, awater_m2 double, geometry_geojson string, "
        "_ingested_at timestamp",
    )
    return staging.tracts(raw)


def test_vulnerability(spark, params):
    tracts = _tracts(spark, {"1": (LON, LAT, 0.001), "2": (LON + 0.001, LAT, 0.001), "3": (LON, LAT, 0.001),
                             "9": (LON + 5, LAT, 0.001)})
    acs = spark.createDataFrame(
        [("14000US1", 100, 0.2, 0.4, 0.6), ("2", 300, None, 0.8, 0.2), ("3", 0, 1.0, 1.0, 1.0),
         ("9", 50, 0.0, 0.0, 0.0)],
        "geoid string, pop_total long, pct_hh_no_vehicle double, pct_transit_commute double, "
        "pct_poverty double",
    )
    stops = _stops(spark, {"S": (LON, LAT), "T": (LON + 5, LAT), "far": (LON + 9, LAT)})
    found = {r.stop_id: r for r in places.vulnerability_by_stop(stops, tracts, acs, params).collect()}
    s = found["S"]
    assert (s.pct_hh_no_vehicle_w, s.pct_transit_commute_w, s.pct_poverty_w) == pytest.approx((0.05, 0.7, 0.3))
    assert (s.vuln_score_0_100, found["T"].vuln_score_0_100) == (100.0, 0.0)
    assert found["far"].vuln_score_0_100 is None


def test_hotspots_of_stops_found_in_one_input_only(spark, params):
    vulnerability = spark.createDataFrame([("a", 80.0), ("b", None), (None, 9.0)], "stop_id string, vuln_score_0_100 double")
    crash = spark.createDataFrame([("b", 0), ("c", 10), ("d", 5)], "stop_id string, crash_250m_cnt long")
    stop_hour = spark.createDataFrame(
        [("e", date(2025, 1, 10), 0.25), ("e", date(2025, 1, 11), 0.75), ("f", date(2024, 12, 1), 0.0),
         ("d", date(2024, 12, 11), 0.25)],
        "stop_id string, service_date_mst date, pct_on_time double",
    )
    mart = places.priority_hotspots(vulnerability, crash, stop_hour, params)
    assert rows(mart, "stop_id", "priority_score", "priority_rank") == ordered(
        [("a", 40.0, 1), ("d", 30.0, 2), ("c", 30.0, 2), ("e", 10.0, 3), ("b", 0.0, 4)]
    )
    assert rows(query.top_hotspots(mart, 2), "stop_id") == [("a",), ("c",)]


def test_hotspot_crash_score_is_missing_when_all_counts_are_equal(spark, params):
    empty = spark.createDataFrame([], "stop_id string, vuln_score_0_100 double")
    crash = spark.createDataFrame([("b", 7), ("c", 7)], "stop_id string, crash_250m_cnt long")
    hours = spark.createDataFrame([], "stop_id string, service_date_mst date, pct_on_time double")
    mart = places.priority_hotspots(empty, crash, hours, params)
    assert rows(mart, "crash_score_0_100", "priority_rank") == [(None, 1), (None, 1)]


def test_distances_are_metric(spark):
    row = spark.range(1).select(geo.haversine_m("-105D", "39.7D", "-105D", f"{north(1000)!r}D").alias("m")).first()
    assert row.m == pytest.approx(1000, abs=1e-3)
    assert math.isclose(geo.METERS_PER_DEGREE, 111195.08, rel_tol=1e-6)


def test_staged_routes_and_stops_follow_name_order(spark):
    raw = spark.createDataFrame(
        [("1", "", "Zed", "d", "3"), ("1", "A", "Abe", "d", "LX2"), ("2", None, "Solo", None, "3")],
        "route_id string, route_short_name string, route_long_name string, route_desc string, route_type string",
    )
    assert rows(staging.routes(raw), "route_id", "route_name", "route_type", "is_active") == [
        ("1", "A", "LX2", True), ("2", "Solo", "3", True),
    ]
    assert _stops(spark, {"x": (None, 1.0)}).first().geom is None


def test_staged_weather_keeps_the_newest_load_even_when_empty(spark):
    raw = spark.createDataFrame(
        [(date(2025, 1, 1), "A", 4.0, utc("2025-01-02 00:00:00")), (date(2025, 1, 1), "A", None, utc("2025-01-03 00:00:00"))],
        "date date, station string, precip_mm double, _ingested_at timestamp",
    )
    absent = [c for c in staging.WEATHER_COLUMNS if c not in raw.columns]
    raw = raw.withColumns({c: F.lit(None).cast("double") for c in absent})
    assert rows(staging.weather(raw), "station", "precip_mm") == [("A", None)]
