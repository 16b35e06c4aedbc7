"""Service calendar and scheduled arrivals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.functions.clock import (
    WEEKDAYS,
    parse_yyyymmdd,
    runs_on,
    service_instant,
    service_seconds,
)
from stopwise.operators.latest import newest_partition
from stopwise.params import Params


def service_dates(
    raw_calendar: DataFrame, raw_calendar_dates: DataFrame, first: date, last: date
) -> DataFrame:
    """Dates each service runs inside an inclusive window.

    The service period is clamped to the window before its dates are generated, so no row is
    made that the window drops. Removed dates go, added dates come, also for services the
    weekly calendar does not know.
    """
    start, end = parse_yyyymmdd("start_date"), parse_yyyymmdd("end_date")
    calendar = (
        newest_partition(raw_calendar)
        .select(
            "service_id",
            *WEEKDAYS,
            F.greatest(start, F.lit(first)).alias("lo"),
            F.least(end, F.lit(last)).alias("hi"),
            (start.isNotNull() & end.isNotNull()).alias("dated"),
        )
        .where("dated and lo <= hi")
    )
    regular = calendar.withColumn(
        "service_date", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day")))
    ).where(runs_on("service_date"))

    exceptions = (
        newest_partition(raw_calendar_dates)
        .select("service_id", "exception_type", parse_yyyymmdd("date").alias("service_date"))
        .where(F.col("service_date").between(F.lit(first), F.lit(last)))
    )
    keys = ["service_id", "service_date"]
    kept = regular.select(keys).join(
        exceptions.where("exception_type = 2").select(keys), keys, "left_anti"
    )
    return kept.union(exceptions.where("exception_type = 1").select(keys)).distinct()


def trip_patterns(trips: DataFrame, running: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stop times of each trip on the service-day clock, with the dates the trip runs.

    Stop times with neither an arrival nor a departure are left out. This is the schedule before expansion: one row per stop time, whatever the number of dates.
    The array is bounded by the days of the expansion window.
    """
    dates = running.groupBy("service_id").agg(
        F.array_sort(F.collect_set("service_date")).alias("service_dates")
    )
    running_trips = trips.select("trip_id", "route_id", "direction_id", "service_id").join(
        dates, "service_id"
    )
    times = stop_times.select(
        "trip_id",
        "stop_id",
        "stop_sequence",
        service_seconds("arrival_time").alias("arrival_sec"),
        service_seconds("departure_time").alias("departure_sec"),
    ).where("arrival_sec is not null or departure_sec is not null")
    return running_trips.drop("service_id").join(times, "trip_id")


def scheduled_arrivals(patterns: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per trip, stop, sequence and service date with its instants.

    Dates multiply the rows here, after every join is done.
    """
    return (
        patterns.withColumn("service_date_mst", F.explode("service_dates")).select(
            "trip_id",
            "stop_id",
            "stop_sequence",
            "route_id",
            "direction_id",
            service_instant("service_date_mst", "arrival_sec", params.zone).alias(
                "sched_arrival_ts_mst"
            ),
            service_instant("service_date_mst", "departure_sec", params.zone).alias(
                "sched_departure_ts_mst"
            ),
            "service_date_mst",
        )
    )


def expansion_window(params: Params) -> tuple[date, date]:
    return (
        params.days_ago(params.schedule_lookback_days),
        params.days_ahead(params.schedule_lookahead_days),
    )
