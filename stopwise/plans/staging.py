"""Clean, deduplicated views of the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.functions.clock import WEEKDAYS, local_date, local_hour
from stopwise.functions.safe import blank_to_null, to_long
from stopwise.functions.steps import computed
from stopwise.operators.latest import first_in_order, newest, newest_partition
from stopwise.params import Params

ACS_COLUMNS = (
    "geoid", "name", "year", "hh_no_vehicle", "hh_total", "workers_transit", "workers_total",
    "persons_poverty", "pop_total", "pct_hh_no_vehicle", "pct_transit_commute", "pct_poverty",
)
WEATHER_COLUMNS = (
    "date", "station", "snow_mm", "precip_mm", "tmin_c", "tmax_c", "tavg_c", "snow_day",
    "precip_bin",
)
CRASH_COLUMNS = (
    "crash_id", "event_ts_utc", "severity", "severity_text", "lon", "lat", "roadway_name",
    "on_route", "off_route", "bike_involved", "ped_involved",
)


def demographics(raw: DataFrame) -> DataFrame:
    """Newest year, then newest load, per tract."""
    rows = raw.select(*ACS_COLUMNS, "_ingested_at")
    return newest(rows, ["geoid"], ["year", "_ingested_at"]).select(*ACS_COLUMNS)


def crashes(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Located crashes, the newest event and worst severity per crash."""
    rows = raw.select(*CRASH_COLUMNS).where("lon is not null and lat is not null")
    rows = newest(rows, ["crash_id"], ["event_ts_utc", "severity"])
    return rows.select(
        "crash_id",
        "event_ts_utc",
        "severity",
        "severity_text",
        geo.point("lon", "lat").alias("geom"),
        "roadway_name",
        "on_route",
        "off_route",
        "bike_involved",
        "ped_involved",
        local_date("event_ts_utc", params.zone).alias("event_date_mst"),
        local_hour("event_ts_utc", params.zone).alias("event_hour_mst"),
    )


def tracts(raw: DataFrame) -> DataFrame:
    """Newest load per tract, with its edges parsed from the GeoJSON text."""
    rows = raw.select("geoid", "name", "aland_m2", "awater_m2", "geometry_geojson", "_ingested_at")
    latest = newest(rows, ["geoid"], ["_ingested_at"])
    return computed(latest, edges=geojson_edges("geometry_geojson")).select(
        "geoid", "name", "aland_m2", "awater_m2", "edges"
    )


def geojson_edges(text: str) -> Column:
    """All ring edges of a GeoJSON Polygon or MultiPolygon as one array.

    Rings are closed when the text leaves them open and zero-length edges are dropped. Text
    that is neither kind of polygon gives NULL.
    """
    coordinates = f"get_json_object({text}, '$.coordinates')"
    ring = "array<array<array<double>>>"
    rings = (
        f"case get_json_object({text}, '$.type') "
        f"when 'Polygon' then from_json({coordinates}, '{ring}') "
        f"when 'MultiPolygon' then flatten(from_json({coordinates}, 'array<{ring}>')) end"
    )
    edges = (
        "zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (a, b) -> "
        "struct(a[0] as lon1, a[1] as lat1, b[0] as lon2, b[1] as lat2))"
    )
    return F.expr(
        f"filter(flatten(transform(filter({rings}, r -> size(r) >= 2), r -> {edges})), "
        "e -> e.lon1 != e.lon2 or e.lat1 != e.lat2)"
    )


def routes(raw: DataFrame) -> DataFrame:
    """One row per route, first by its names over all extracts."""
    rows = raw.select("route_id", "route_long_name", "route_desc", "route_short_name", "route_type")
    rows = first_in_order(
        rows, ["route_id"], ["route_long_name", "route_desc", "route_short_name"]
    )
    return rows.select(
        "route_id",
        F.coalesce(blank_to_null(F.col("route_short_name")), "route_long_name").alias(
            "route_name"
        ),
        "route_long_name",
        "route_type",
        "route_desc",
        F.lit(True).alias("is_active"),
    )


def stops(raw: DataFrame) -> DataFrame:
    """One row per stop, first by name and position over all extracts."""
    rows = raw.select("stop_id", "stop_name", "stop_lat", "stop_lon", "wheelchair_boarding")
    rows = first_in_order(rows, ["stop_id"], ["stop_name", "stop_lat", "stop_lon"])
    return rows.select(
        "stop_id",
        "stop_name",
        "stop_lat",
        "stop_lon",
        geo.point("stop_lon", "stop_lat").alias("geom"),
        to_long(F.col("wheelchair_boarding")).alias("wheelchair_boarding"),
    )


def stop_times(raw: DataFrame) -> DataFrame:
    """Newest extract, earliest arrival text per trip, stop and sequence."""
    rows = newest_partition(raw).select(
        "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"
    )
    rows = first_in_order(rows, ["trip_id", "stop_id", "stop_sequence"], ["arrival_time"])

    def hour(text: str) -> Column:
        return to_long(F.try_element_at(F.split(text, ":"), F.lit(1)))

    return rows.withColumns(
        {
            "arr_hour_gtfs": hour("arrival_time"),
            "dep_hour_gtfs": hour("departure_time"),
            "arr_hour_bucket": hour("arrival_time"),
        }
    )


def service_exceptions(raw_calendar_dates: DataFrame) -> DataFrame:
    """Added and removed dates per service, distinct and sorted; NULL when there are none.

    Distinct dates bound the arrays by the length of the calendar.
    """
    rows = newest_partition(raw_calendar_dates)

    def dates(kind: int) -> Column:
        found = F.collect_set(F.when(F.col("exception_type") == kind, F.col("date")))
        return F.when(F.size(found) > 0, F.array_sort(found))

    return rows.groupBy("service_id").agg(
        dates(1).alias("added_service_dates"), dates(2).alias("removed_service_dates")
    )


def trips(raw: DataFrame, raw_calendar: DataFrame, raw_calendar_dates: DataFrame) -> DataFrame:
    """Newest extract, first service per trip, with its calendar and exceptions."""
    columns = ["trip_id", "route_id", "service_id", "direction_id", "shape_id", "trip_headsign"]
    rows = first_in_order(newest_partition(raw).select(*columns), ["trip_id"], ["service_id"])
    calendar = newest_partition(raw_calendar).select(
        "service_id", "start_date", "end_date", *WEEKDAYS[1:], WEEKDAYS[0]
    )
    calendar = first_in_order(calendar, ["service_id"], ["start_date", "end_date"])
    return rows.join(calendar, "service_id", "left").join(
        service_exceptions(raw_calendar_dates), "service_id", "left"
    )


def weather(raw: DataFrame) -> DataFrame:
    """Newest load per date and station, even when its measures are missing."""
    rows = raw.select(*WEATHER_COLUMNS, "_ingested_at")
    return newest(rows, ["date", "station"], ["_ingested_at"]).select(*WEATHER_COLUMNS)


def sidewalks(raw: DataFrame, all_extracts: bool = False) -> DataFrame:
    """Sidewalks as start-end chords, of the newest extract unless all are asked for."""
    rows = raw if all_extracts else newest_partition(raw)
    return rows.select(
        "sidewalk_id",
        "class",
        "status",
        "material",
        "year_built",
        "length_m",
        geo.chord("lon_start", "lat_start", "lon_end", "lat_end").alias("geom"),
        geo.point("centroid_lon", "centroid_lat").alias("centroid"),
    )
