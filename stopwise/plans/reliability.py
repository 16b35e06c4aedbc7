"""Reliability marts and their weather context."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.clock import local_hour
from stopwise.params import Params

STOP_HOUR = ["stop_id", "service_date_mst", "event_hour_mst"]


def quantile(column: str, share: float, exact: bool) -> Column:
    """A whole-number quantile that is one of the values.

    Approximate sketches merge map-side and stay small. The exact form keeps a count per
    distinct value, which for delays in seconds is bounded too, and is meant for checks.
    """
    if exact:
        value = F.expr(f"percentile_disc({share}) within group (order by {column})")
    else:
        value = F.percentile_approx(column, share)
    return value.cast("long")


def weather_by_date(weather: DataFrame, params: Params = Params()) -> DataFrame:
    """Snow flag and the bin of the wettest station that has a bin, per date."""
    if params.weather_station is not None:
        weather = weather.where(F.col("station") == params.weather_station)
    wettest = F.max(
        F.when(
            F.col("precip_bin").isNotNull(),
            F.struct(
                F.coalesce(F.col("precip_mm").cast("double"), F.lit(float("-inf"))).alias("mm"),
                F.col("precip_bin"),
            ),
        )
    )
    return weather.groupBy(F.col("date").alias("service_date_mst")).agg(
        (F.max(F.coalesce("snow_day", F.lit(0))) > 0).alias("snow_day"),
        wettest.getField("precip_bin").alias("precip_bin"),
    )


def _since(df: DataFrame, since: date | None) -> DataFrame:
    return df if since is None else df.where(F.col("service_date_mst") >= F.lit(since))


def reliability_by_route_day(
    resolved: DataFrame,
    weather_days: DataFrame,
    params: Params = Params(),
    since: date | None = None,
    exact: bool = False,
) -> DataFrame:
    """Counts, on-time share and delays per route, date and weather.

    Days without weather count as dry. Weather has one row per date, so events are first
    aggregated by route and date, in one shuffle of partial aggregates, and only the mart meets it.
    """
    events = _since(resolved, since).select(
        "route_id", "service_date_mst", "delay_sec", "delay_sec_raw"
    )
    on_time = (F.abs("delay_sec") <= params.on_time_sec).cast("int")
    days = events.groupBy("route_id", "service_date_mst").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("delay_sec_raw").alias("n_reported_events"),
        F.avg(on_time).alias("pct_on_time"),
        F.avg("delay_sec").alias("mean_delay_sec"),
        quantile("delay_sec", 0.5, exact).alias("median_delay_sec"),
        quantile("delay_sec", 0.9, exact).alias("p90_delay_sec"),
    )
    return days.join(weather_days, "service_date_mst", "left").select(
        "route_id",
        "service_date_mst",
        F.coalesce("precip_bin", F.lit("none")).alias("precip_bin"),
        F.coalesce("snow_day", F.lit(False)).alias("snow_day"),
        *days.columns[2:],
        F.lit(params.now).alias("build_run_at"),
    )


def stop_hour_headways(
    adherence: DataFrame, params: Params = Params(), exact: bool = False
) -> DataFrame:
    """Adherence rate and observed headway quantiles per stop, date and local hour."""
    hour = local_hour("event_ts_utc", params.zone).alias("event_hour_mst")
    return adherence.groupBy("stop_id", "service_date_mst", hour).agg(
        F.avg("headway_adherent").alias("headway_adherence_rate"),
        quantile("obs_headway_sec", 0.5, exact).alias("obs_headway_sec_p50"),
        quantile("obs_headway_sec", 0.9, exact).alias("obs_headway_sec_p90"),
    )


def stop_hour_delays(
    resolved: DataFrame,
    params: Params = Params(),
    since: date | None = None,
    exact: bool = False,
) -> DataFrame:
    """Counts, on-time share, delays and the commonest route per stop, date and hour.

    The commonest route (smallest id on a tie) is one more state of the same aggregate: a count
    per route of the stop and hour.
    """
    on_time = (F.abs("delay_sec") <= params.on_time_sec).cast("int")
    return (
        _since(resolved, since)
        .where("stop_id is not null")
        .groupBy(*STOP_HOUR)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.avg(on_time).alias("pct_on_time"),
            F.avg("delay_sec").alias("mean_delay_sec"),
            quantile("delay_sec", 0.9, exact).alias("p90_delay_sec"),
            F.coalesce(F.mode("route_id", True), F.lit("unknown")).alias("route_id_mode"),
        )
    )


def reliability_by_stop_hour(
    resolved: DataFrame,
    adherence: DataFrame,
    params: Params = Params(),
    since: date | None = None,
    exact: bool = False,
) -> DataFrame:
    """Stop-hour delays with their headways; both sides arrive grouped on the join keys."""
    delays = stop_hour_delays(resolved, params, since, exact)
    headways = stop_hour_headways(_since(adherence, since), params, exact)
    return delays.join(headways, STOP_HOUR, "left").withColumn(
        "build_run_at", F.lit(params.now)
    )


def weather_impacts(route_day: DataFrame, params: Params = Params()) -> DataFrame:
    """Mean of daily on-time shares per route and bin, against the route's dry days.

    After the aggregate a route has one row per bin, so the window stays tiny.
    """
    average = route_day.groupBy("route_id", "precip_bin").agg(
        F.avg("pct_on_time").alias("pct_on_time_avg")
    )
    dry = F.max(F.when(F.col("precip_bin") == "none", F.col("pct_on_time_avg"))).over(
        Window.partitionBy("route_id")
    )
    # Routes without an id have no baseline.
    dry = F.when(F.col("route_id").isNotNull(), dry)
    return (
        average.withColumn("pct_on_time_normal", dry)
        .withColumn("delta_pct_on_time", F.col("pct_on_time_avg") - F.col("pct_on_time_normal"))
        .withColumn("build_run_at", F.lit(params.now))
    )
