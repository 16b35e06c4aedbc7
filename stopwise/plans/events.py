"""Realtime events: feeds to one resolved event per snapshot and trip."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.functions.clock import (
    local_date,
    local_hour,
    seconds_between,
    service_instant,
    utc_date,
)
from stopwise.operators.skew import never_matching
from stopwise.params import Params

KEYS = ["feed_ts_utc", "trip_id", "route_id"]
UPDATE_FIELDS = (
    "stop_sequence", "stop_id", "arrival_delay_sec", "departure_delay_sec",
    "schedule_relationship",
)
POSITION_FIELDS = (
    "vehicle_id", "vehicle_label", "lon", "lat", "bearing", "speed_mps",
)
_UPDATE = ", ".join(["entity_id as id", *UPDATE_FIELDS])
_POSITION = ", ".join(["entity_id as id", *POSITION_FIELDS])
# A row of a feed as what its candidates are the greatest of.
UPDATE_ROWS = {
    "timed": f"case when event_ts_utc is not null then struct(event_ts_utc as at, {_UPDATE}) end",
    "untimed": f"case when event_ts_utc is null then struct({_UPDATE}) end",
}
POSITION_ROWS = {
    "by_id": f"struct({_POSITION})",
    "by_time": f"struct(coalesce(event_ts_utc, feed_ts_utc) as at, {_POSITION})",
}


def recent(feed: DataFrame, params: Params, incremental: bool = False) -> DataFrame:
    """Rows of the lookback window by instant and, for partition pruning, by UTC date."""
    if incremental:
        since = params.now - timedelta(hours=params.rt_incremental_hours)
        first_day = params.now.date() - timedelta(days=1)
    else:
        since = params.now - timedelta(days=params.rt_lookback_days)
        first_day = params.now.date() - timedelta(days=params.rt_lookback_days)
    day = F.col("feed_date") if "feed_date" in feed.columns else utc_date("feed_ts_utc")
    return feed.where((day >= F.lit(first_day)) & (F.col("feed_ts_utc") >= _instant(since)))


def _instant(moment: datetime) -> Column:
    return F.timestamp_micros(F.lit(int(moment.timestamp()) * 1_000_000 + moment.microsecond))


def merge_feeds(updates: DataFrame, positions: DataFrame) -> DataFrame:
    """The latest event per snapshot and trip out of both feeds.

    It equals a full outer join of the feeds on snapshot, trip and route, followed by the row
    with the latest event time (of the update, else the position, else the snapshot), then the
    greatest update and vehicle ids, then the greatest remaining values.

    That row never needs the pairs. With a timed update it is made of the greatest timed update
    and the position with the greatest id; without, of the greatest update and the latest
    position. So each feed first shrinks to two candidate rows per key, map-side, and the join
    is one row to one row.
    """
    best = best_event(updates)
    winners = (
        update_candidates(updates)
        .join(position_candidates(positions), KEYS, "full")
        .selectExpr("feed_ts_utc", "trip_id", f"{best} as best")
        .groupBy("feed_ts_utc", "trip_id")
        .agg(F.expr("max(best) as best"))
    )
    return winners.selectExpr("feed_ts_utc", "trip_id", "best.*")


def update_candidates(updates: DataFrame) -> DataFrame:
    """The greatest timed and the greatest untimed update per snapshot, trip and route."""
    return updates.groupBy(*KEYS).agg(*[F.expr(f"max({row}) as {n}") for n, row in UPDATE_ROWS.items()])


def position_candidates(positions: DataFrame) -> DataFrame:
    """The position with the greatest id and the latest one per snapshot, trip and route."""
    return positions.groupBy(*KEYS).agg(*[F.expr(f"max({row}) as {n}") for n, row in POSITION_ROWS.items()])


def best_event(updates: DataFrame, update: str = "", position: str = "", route: str = "route_id") -> str:
    """The event of a key out of its candidates, as a struct that is greater for later events.

    ``update`` and ``position`` go before the names of the candidates.
    """
    timed, untimed = f"{update}timed", f"{update}untimed"
    by_id, by_time = f"{position}by_id", f"{position}by_time"
    types = dict(updates.dtypes)

    def fields(source: str, names: tuple[str, ...]) -> list[str]:
        return [f"{source}.{n} as {n}" for n in names]

    def candidate(when: str, update_id: str, own: list[str], place: str) -> str:
        """The event's order columns first, then what breaks ties."""
        parts = [
            f"{when} as event_ts_utc",
            f"{update_id} as tu_entity_id",
            f"{place}.id as vp_entity_id",
            *own,
            *fields(place, POSITION_FIELDS),
            f"{route} as route_id",
        ]
        return f"struct({', '.join(parts)})"

    fallback = f"coalesce({by_time}.at, feed_ts_utc)"
    first = candidate(f"{timed}.at", f"{timed}.id", fields(timed, UPDATE_FIELDS), by_id)
    second = candidate(fallback, f"{untimed}.id", fields(untimed, UPDATE_FIELDS), by_time)
    nothing = [f"cast(null as {types[n]}) as {n}" for n in UPDATE_FIELDS]
    alone = candidate(fallback, "cast(null as string)", nothing, by_time)
    return (
        f"greatest(case when {timed} is not null then {first} end, "
        f"case when {untimed} is not null then {second} end, "
        f"case when {timed} is null and {untimed} is null then {alone} end)"
    )


def rt_events(
    updates: DataFrame,
    positions: DataFrame,
    trips: DataFrame,
    patterns: DataFrame,
    params: Params = Params(),
    incremental: bool = False,
) -> DataFrame:
    """Merged events with trip attributes and delays, reported or taken from the schedule.

    The schedule is joined unexpanded: an event meets the stop time of its trip, stop and
    sequence, and the event's local date must be one of the dates the trip runs. The instant is
    then computed for that date alone.
    """
    events = merge_feeds(
        recent(updates, params, incremental), recent(positions, params, incremental)
    )
    events = events.withColumns(
        {
            "event_date_mst": local_date("event_ts_utc", params.zone),
            "event_hour_mst": local_hour("event_ts_utc", params.zone),
            # Events without a stop (positions alone) must not meet in one task.
            "_stop": never_matching(F.col("stop_id"), F.col("feed_ts_utc"), F.col("trip_id")),
        }
    )
    dimension = trips.select("trip_id", "direction_id", "trip_headsign")
    times = patterns.select(
        "trip_id",
        F.col("stop_id").alias("_stop"),
        "stop_sequence",
        "arrival_sec",
        "departure_sec",
        "service_dates",
    )
    joined = (
        events.join(dimension, "trip_id", "left")
        .join(times, ["trip_id", "_stop", "stop_sequence"], "left")
        .withColumn("_runs", F.expr("array_contains(service_dates, event_date_mst)"))
        .withColumns(
            {
                f"_{kind}": F.when(
                    F.col("_runs"),
                    service_instant("event_date_mst", f"{kind}_sec", params.zone),
                )
                for kind in ("arrival", "departure")
            }
        )
    )

    def delay(reported: str, scheduled: str) -> Column:
        late = seconds_between("event_ts_utc", scheduled)
        return F.coalesce(reported, late).alias(reported)

    return joined.select(
        "feed_ts_utc",
        "trip_id",
        "route_id",
        "tu_entity_id",
        "vp_entity_id",
        "stop_id",
        "stop_sequence",
        delay("arrival_delay_sec", "_arrival"),
        delay("departure_delay_sec", "_departure"),
        "schedule_relationship",
        "vehicle_id",
        "vehicle_label",
        "lon",
        "lat",
        "bearing",
        "speed_mps",
        geo.point("lon", "lat").alias("geom"),
        "event_ts_utc",
        "direction_id",
        "trip_headsign",
        "event_date_mst",
        "event_hour_mst",
    )


def resolve(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Delay per event: arrival, else departure, else zero; on time within the tolerance."""
    raw = F.coalesce("arrival_delay_sec", "departure_delay_sec")
    delay = F.coalesce(raw, F.lit(0))
    return events.select(
        "route_id",
        "trip_id",
        "stop_id",
        "direction_id",
        F.col("event_date_mst").alias("service_date_mst"),
        "event_hour_mst",
        "event_ts_utc",
        delay.alias("delay_sec"),
        raw.alias("delay_sec_raw"),
        (F.abs(delay) <= params.on_time_sec).cast("int").alias("is_on_time"),
    )
