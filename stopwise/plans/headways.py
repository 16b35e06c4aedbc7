"""Headways as observed and scheduled, and how well they agree."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.clock import seconds_between
from stopwise.operators.nearest import nearest_in_time
from stopwise.params import Params

KEYS = ["route_id", "direction_id", "stop_id", "service_date_mst"]
ADHERENCE_DDL = (
    "route_id string, direction_id long, stop_id string, service_date_mst date, "
    "event_ts_utc timestamp, obs_headway_sec long, sch_headway_sec long, dt_abs long, "
    "headway_adherent int"
)


def _gaps(arrivals: DataFrame, ts: str, output: str) -> DataFrame:
    """Adds the arrival before, ``_previous``, and the seconds since."""
    previous = F.lag(ts).over(Window.partitionBy(*KEYS).orderBy(ts))
    return arrivals.withColumn("_previous", previous).withColumn(
        output, seconds_between(ts, "_previous")
    )


def headways_observed(
    resolved: DataFrame, params: Params = Params(), since: date | None = None
) -> DataFrame:
    """Seconds since the previous distinct arrival of the same key and date.

    Copies of an arrival are dropped map-side first: events without a stop share few keys. Feed times
    are whole seconds, so the window of a key then holds at most the seconds of one service day.
    """
    since = since or params.days_ago(params.rt_lookback_days)
    ts = "event_ts_utc"
    recent = resolved.where((F.col("service_date_mst") >= F.lit(since)) & F.col(ts).isNotNull())
    distinct = recent.select(*KEYS, ts).dropDuplicates()
    return _gaps(distinct, ts, "obs_headway_sec").drop("_previous")


def headways_scheduled(scheduled: DataFrame) -> DataFrame:
    """Seconds since the previous distinct scheduled arrival of the same key and date.

    A schedule has few copies of an arrival, so a map-side dedup would only hold nearly all rows
    of the expanded schedule in memory. Copies follow each other in the order of the window, and
    one whose predecessor has the same time is left out.
    """
    ts = "sched_arrival_ts_mst"
    arrivals = scheduled.select(*KEYS, ts).where(F.col(ts).isNotNull())
    gaps = _gaps(arrivals, ts, "sch_headway_sec")
    first = F.col("_previous").isNull() | (F.col("_previous") != F.col(ts))
    return gaps.where(first).drop("_previous")


def nearest_schedule(
    observed: DataFrame,
    scheduled: DataFrame,
    params: Params = Params(),
    since: date | None = None,
) -> DataFrame:
    """Each observed headway with the scheduled one nearest in time, same key and date.

    A missing direction matches a missing direction; observations without a schedule on their
    key and date drop out. Rows that can never match do not enter the shuffle.
    """
    since = since or params.days_ago(params.schedule_lookback_days)
    usable = (
        F.col("route_id").isNotNull()
        & F.col("stop_id").isNotNull()
        & (F.col("service_date_mst") >= F.lit(since))
    )
    return nearest_in_time(
        observed.where(usable & F.col("obs_headway_sec").isNotNull()),
        scheduled.where(usable & F.col("sch_headway_sec").isNotNull()),
        KEYS,
        "event_ts_utc",
        "sched_arrival_ts_mst",
        "sch_headway_sec",
    )


def headway_adherence(
    observed: DataFrame,
    scheduled: DataFrame,
    params: Params = Params(),
    since: date | None = None,
) -> DataFrame:
    """1 when the nearest schedule is close enough and the gaps agree within the tolerance."""
    gap = F.col("sch_headway_sec")
    error = F.abs(F.col("obs_headway_sec") - gap) / F.nullif(gap, F.lit(0))
    adherent = (
        (F.col("dt_abs") <= params.sched_match_tol_sec)
        & (gap > 0)
        & (error <= params.headway_tol_ratio)
    )
    matched = nearest_schedule(observed, scheduled, params, since)
    return matched.select(
        *KEYS,
        "event_ts_utc",
        "obs_headway_sec",
        "sch_headway_sec",
        "dt_abs",
        F.coalesce(adherent, F.lit(False)).cast("int").alias("headway_adherent"),
    )
