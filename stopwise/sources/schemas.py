"""Declared schemas of the raw datasets. Loads never infer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

# Folders, file names, columns and types of the raw drops.
_NUM = "decimal(38,9)"


@dataclass(frozen=True)
class Dataset:
    table: str
    folder: str
    label: str  # partition label of a drop: extract_date or snapshot_at
    file: str
    ddl: str
    partition: str | None = None  # timestamp or date column that gives the day folder
    cluster: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


DATASETS: dict[str, Dataset] = {
    d.table: d
    for d in (
        Dataset(
            "raw_acs_tract", "acs", "extract_date", "acs_tract.csv.gz",
            "geoid string, name string, year long, hh_no_vehicle long, hh_total long, "
            "workers_transit long, workers_total long, persons_poverty long, pop_total long, "
            f"pct_hh_no_vehicle {_NUM}, pct_transit_commute {_NUM}, pct_poverty {_NUM}",
        ),
        Dataset(
            "raw_crashes", "denver_crashes", "extract_date", "crashes.csv.gz",
            "crash_id string, event_ts_utc timestamp, severity long, severity_text string, "
            "lat double, lon double, roadway_name string, on_route string, off_route string, "
            "bike_involved long, ped_involved long",
            "event_ts_utc", ("severity",),
        ),
        Dataset(
            "raw_sidewalks", "denver_sidewalks", "extract_date", "sidewalks.csv.gz",
            "sidewalk_id string, class string, status string, material string, "
            "year_built string, lon_start double, lat_start double, lon_end double, "
            "lat_end double, length_m double, centroid_lon double, centroid_lat double",
        ),
        Dataset(
            "raw_denver_tracts", "denver_tracts", "extract_date", "tracts.csv.gz",
            f"geoid string, name string, aland_m2 {_NUM}, awater_m2 {_NUM}, "
            "geometry_geojson string",
        ),
        Dataset(
            "raw_weather_daily", "noaa_daily", "extract_date", "weather.csv.gz",
            f"date date, station string, snow_mm {_NUM}, precip_mm {_NUM}, tmin_c {_NUM}, "
            f"tmax_c {_NUM}, tavg_c {_NUM}, snow_day long, precip_bin string",
            "date",
        ),
        Dataset(
            "raw_gtfs_routes", "rtd_gtfs", "extract_date", "gtfs/routes.txt",
            "route_id string, agency_id string, route_short_name string, "
            "route_long_name string, route_desc string, route_type string, route_url string, "
            "route_color string, route_text_color string",
            None, ("route_id",),
        ),
        Dataset(
            "raw_gtfs_stops", "rtd_gtfs", "extract_date", "gtfs/stops.txt",
            "stop_id string, stop_code string, stop_name string, stop_desc string, "
            "stop_lat double, stop_lon double, zone_id string, stop_url string, "
            "location_type long, parent_station string, stop_timezone string, "
            "wheelchair_boarding long, platform_code string",
            None, ("stop_id",),
        ),
        Dataset(
            "raw_gtfs_trips", "rtd_gtfs", "extract_date", "gtfs/trips.txt",
            "route_id string, service_id string, trip_id string, trip_headsign string, "
            "direction_id long, block_id string, shape_id string",
        ),
        Dataset(
            "raw_gtfs_calendar", "rtd_gtfs", "extract_date", "gtfs/calendar.txt",
            "service_id string, monday long, tuesday long, wednesday long, thursday long, "
            "friday long, saturday long, sunday long, start_date string, end_date string",
        ),
        Dataset(
            "raw_gtfs_calendar_dates", "rtd_gtfs", "extract_date", "gtfs/calendar_dates.txt",
            "service_id string, date string, exception_type long",
        ),
        Dataset(
            "raw_gtfs_stop_times", "rtd_gtfs", "extract_date", "gtfs/stop_times.txt",
            "trip_id string, arrival_time string, departure_time string, stop_id string, "
            "stop_sequence long, stop_headsign string, pickup_type long, drop_off_type long, "
            "shape_dist_traveled double, timepoint long",
        ),
        Dataset(
            "raw_gtfs_shapes", "rtd_gtfs", "extract_date", "gtfs/shapes.txt",
            "shape_id string, shape_pt_lat double, shape_pt_lon double, "
            "shape_pt_sequence long, shape_dist_traveled double",
        ),
        Dataset(
            "raw_gtfsrt_trip_updates", "rtd_gtfsrt", "snapshot_at", "trip_updates.csv.gz",
            "feed_ts_utc timestamp, entity_id string, trip_id string, route_id string, "
            "stop_id string, stop_sequence long, arrival_delay_sec long, "
            "departure_delay_sec long, schedule_relationship string, event_ts_utc timestamp, "
            "start_date string, start_time string",
            "feed_ts_utc", ("route_id", "trip_id"),
        ),
        Dataset(
            "raw_gtfsrt_vehicle_positions", "rtd_gtfsrt", "snapshot_at",
            "vehicle_positions.csv.gz",
            "feed_ts_utc timestamp, entity_id string, trip_id string, route_id string, "
            "vehicle_id string, vehicle_label string, lon double, lat double, bearing double, "
            "speed_mps double, event_ts_utc timestamp",
            "feed_ts_utc", ("route_id", "trip_id"),
        ),
    )
}

# Day folders of the raw tables; tables without an own date go by extract date.
DAY_FOLDER = {"feed_ts_utc": "feed_date", "event_ts_utc": "event_date", "date": "date"}

PROVENANCE = "_ingested_at timestamp, _source_path string, _extract_date date, _hash_md5 string"
MANIFEST = "files map<string, struct<row_count: bigint, bytes: bigint, hash_md5: string>>"
LEDGER = (
    "_source_path string, _hash_md5 string, _loaded_at timestamp, table string, rows long"
)
FILE_HASHES = "source_path string, bytes long, modified timestamp, hash_md5 string"
EXPORT_STATE = "mart_name string, last_service_date date, last_run_ts timestamp"

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "encoding": "UTF-8",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
}
