"""Landed realtime feeds to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Landed shape of the two feeds, one row per snapshot with its capture time.
TRIP_FEED = """captured_at timestamp, entity array<struct<id: string, trip_update: struct<
    trip: struct<trip_id: string, route_id: string, start_date: string, start_time: string,
                 schedule_relationship: string>,
    timestamp: bigint,
    stop_time_update: array<struct<stop_id: string, stop_sequence: bigint,
        arrival: struct<delay: bigint, time: bigint>,
        departure: struct<delay: bigint, time: bigint>>>>>>"""
VEHICLE_FEED = """captured_at timestamp, entity array<struct<id: string, vehicle: struct<
    trip: struct<trip_id: string, route_id: string>,
    vehicle: struct<id: string, label: string>,
    position: struct<longitude: double, latitude: double, bearing: double, speed: double>,
    timestamp: bigint>>>"""

# Plausible delays in seconds and the service area.
DELAY_RANGE = (-3600, 7200)
SERVICE_AREA = {"lon": (-105.5, -104.4), "lat": (39.4, 40.2)}


def feed_minute(captured_at: str = "captured_at") -> Column:
    """Snapshot time: the capture time cut to the minute."""
    return F.date_trunc("minute", captured_at)


def wanted_routes(rows: DataFrame, route_filter: str | None) -> DataFrame:
    """Rows of a comma-separated list of routes; no list keeps all, also those without a route."""
    routes = [r.strip() for r in (route_filter or "").split(",") if r.strip()]
    return rows.where(F.col("route_id").isin(routes)) if routes else rows


def trip_updates(feed: DataFrame, route_filter: str | None = None) -> DataFrame:
    """One row per entity and stop-time update.

    The event time is the arrival's, else the departure's, else the entity's unless zero, else
    the snapshot's. Empty text is missing.
    """
    entities = feed.select(
        feed_minute().alias("feed_ts_utc"), F.explode("entity").alias("e")
    ).where("e.trip_update is not null")
    updates = entities.select("feed_ts_utc", "e", F.inline("e.trip_update.stop_time_update"))
    event = (
        "coalesce(timestamp_seconds(arrival.time), timestamp_seconds(departure.time), "
        "timestamp_seconds(nullif(e.trip_update.timestamp, 0)), feed_ts_utc)"
    )
    rows = updates.selectExpr(
        "feed_ts_utc",
        "nullif(e.id, '') as entity_id",
        "nullif(e.trip_update.trip.trip_id, '') as trip_id",
        "nullif(e.trip_update.trip.route_id, '') as route_id",
        "nullif(stop_id, '') as stop_id",
        "stop_sequence",
        "arrival.delay as arrival_delay_sec",
        "departure.delay as departure_delay_sec",
        "coalesce(e.trip_update.trip.schedule_relationship, 'SCHEDULED') "
        "as schedule_relationship",
        f"{event} as event_ts_utc",
        "nullif(e.trip_update.trip.start_date, '') as start_date",
        "nullif(e.trip_update.trip.start_time, '') as start_time",
    )
    return wanted_routes(rows, route_filter)


def delay_outliers(updates: DataFrame, delay_range: Sequence[int] = DELAY_RANGE) -> DataFrame:
    """Number of arrival and departure delays outside the plausible range; rows are kept."""
    lo, hi = delay_range
    return updates.agg(
        F.expr(
            f"count_if(arrival_delay_sec not between {lo} and {hi}) "
            f"+ count_if(departure_delay_sec not between {lo} and {hi}) as delay_outlier_count"
        )
    )


def vehicle_positions(feed: DataFrame, route_filter: str | None = None) -> DataFrame:
    entities = feed.select(
        feed_minute().alias("feed_ts_utc"), F.explode("entity").alias("e")
    ).where("e.vehicle is not null")
    rows = entities.selectExpr(
        "feed_ts_utc",
        "nullif(e.id, '') as entity_id",
        "nullif(e.vehicle.trip.trip_id, '') as trip_id",
        "nullif(e.vehicle.trip.route_id, '') as route_id",
        "nullif(e.vehicle.vehicle.id, '') as vehicle_id",
        "nullif(e.vehicle.vehicle.label, '') as vehicle_label",
        "e.vehicle.position.longitude as lon",
        "e.vehicle.position.latitude as lat",
        "e.vehicle.position.bearing as bearing",
        "e.vehicle.position.speed as speed_mps",
        "coalesce(timestamp_seconds(e.vehicle.timestamp), feed_ts_utc) as event_ts_utc",
    )
    return wanted_routes(rows, route_filter)


def inside_area(area: dict[str, tuple[float, float]] = SERVICE_AREA) -> str:
    """SQL text: the position lies in the service area; NULL without a position."""
    return " and ".join(f"{c} between {lo!r}D and {hi!r}D" for c, (lo, hi) in area.items())


def position_quality(positions: DataFrame) -> DataFrame:
    """Share of positions inside the service area in percent (NULL if none) and those outside."""
    located = positions.where("lon is not null and lat is not null")
    return located.agg(
        F.expr(f"count_if({inside_area()}) * 100D / nullif(count(*), 0) as in_bbox_pct"),
        F.expr(f"count_if(not ({inside_area()})) as out_of_bbox_count"),
    )
