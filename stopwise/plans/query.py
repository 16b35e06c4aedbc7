"""Governed queries over the marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.params import Params

# The marts open to queries, and those whose rows are partitioned by date.
MARTS = (
    "mart_reliability_by_route_day",
    "mart_reliability_by_stop_hour",
    "mart_crash_proximity_by_stop",
    "mart_access_score_by_stop",
    "mart_vulnerability_by_stop",
    "mart_priority_hotspots",
    "mart_weather_impacts",
    "mart_gtfs_stops",
    "mart_gtfs_routes",
)
DATE_COLUMN = "service_date_mst"
DATED_MARTS = MARTS[:2]


@dataclass(frozen=True)
class Filters:
    start_date: date | None = None
    end_date: date | None = None
    routes: Sequence[str] = ()
    stop_id: str = ""
    weather: Sequence[str] = ()


def mart(marts: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in MARTS:
        raise ValueError(f"mart not allowed: {name}")
    return marts[name]


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Each filter that has a value and whose column exists."""
    if filters.start_date and filters.end_date and DATE_COLUMN in df.columns:
        df = df.where(
            F.col(DATE_COLUMN).between(F.lit(filters.start_date), F.lit(filters.end_date))
        )
    if filters.routes and "route_id" in df.columns:
        df = df.where(F.col("route_id").isin(list(filters.routes)))
    if filters.stop_id.strip() and "stop_id" in df.columns:
        df = df.where(F.col("stop_id") == filters.stop_id.strip().upper())
    if filters.weather and "precip_bin" in df.columns:
        df = df.where(F.col("precip_bin").isin(list(filters.weather)))
    return df


def mart_query(
    marts: Mapping[str, DataFrame],
    name: str,
    filters: Filters = Filters(),
    limit: int | None = None,
) -> DataFrame:
    """Rows of an allowed mart under structured filters, all of them unless a limit is given.

    A mart partitioned by date needs a date range.
    """
    df = mart(marts, name)
    if name in DATED_MARTS and not (filters.start_date and filters.end_date):
        raise ValueError(f"{name} needs a date range on {DATE_COLUMN}")
    return first_rows(apply_filters(df, filters), limit)


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or the first ones in the order of the columns, so that it is defined which."""
    return df if limit is None else df.orderBy(*df.columns).limit(limit)


def preview(marts: Mapping[str, DataFrame], name: str, limit: int) -> DataFrame:
    return first_rows(mart(marts, name), limit)


def display(df: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows to show and the true row count."""
    return first_rows(df, limit), df.agg(F.count(F.lit(1)).alias("total_rows"))


def enrich(df: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop and route labels that a result lacks, joined by id as text.

    Spark picks the join from the sizes.
    """
    lookups = (
        ("stop_id", stops, ("stop_name", "lat", "lon")),
        ("route_id", routes, ("route_name", "route_long_name")),
    )
    for key, lookup, labels in lookups:
        absent = [c for c in labels if c not in df.columns]
        if key in df.columns and absent:
            df = df.withColumn(key, F.col(key).cast("string")).join(
                lookup.select(key, *absent), key, "left"
            )
    return df


def export_rows(
    df: DataFrame,
    date_column: str | None = None,
    start: date | None = None,
    end: date | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of a CSV download: optional date range, and the caller's row limit if there is one."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    if date_column and start and end:
        if start > end:
            raise ValueError("start must be on or before end")
        df = df.where(F.col(date_column).between(F.lit(start), F.lit(end)))
    return first_rows(df, limit)


# -- prepared questions -----------------------------------------------------------------


def _since(params: Params, days: int) -> date:
    return params.today - timedelta(days=days)


def worst_routes(route_day: DataFrame, params: Params = Params(), k: int = 10) -> DataFrame:
    """Routes with the lowest mean on-time share over 30 days."""
    return (
        route_day.where(F.col(DATE_COLUMN) >= F.lit(_since(params, 30)))
        .groupBy("route_id")
        .agg(F.avg("pct_on_time").alias("avg_pct_on_time"))
        .orderBy("avg_pct_on_time", "route_id")
        .limit(k)
    )


def delay_ratio(route_day: DataFrame, params: Params = Params(), k: int = 10) -> DataFrame:
    """Routes with the highest mean late share over 30 days, with their mean delay."""
    return (
        route_day.where(F.col(DATE_COLUMN) >= F.lit(_since(params, 30)))
        .groupBy("route_id")
        .agg(
            F.avg(1 - F.col("pct_on_time")).alias("avg_delay_ratio"),
            F.avg("mean_delay_sec").alias("avg_delay_seconds"),
        )
        .orderBy(F.desc("avg_delay_ratio"), "route_id")
        .limit(k)
    )


def top_crash_stops(crash_proximity: DataFrame, k: int = 20) -> DataFrame:
    ranked = crash_proximity.select("stop_id", "crash_250m_cnt")
    return ranked.orderBy(F.desc("crash_250m_cnt"), "stop_id").limit(k)


def snow_effect(impacts: DataFrame, k: int = 10) -> DataFrame:
    """Routes that lose most in wet weather; routes without a dry baseline come first."""
    wet = impacts.where(F.col("precip_bin").isin("mod", "heavy"))
    return (
        wet.orderBy(F.asc_nulls_first("delta_pct_on_time"), "route_id", "precip_bin")
        .select("route_id", "precip_bin", "delta_pct_on_time")
        .limit(k)
    )


def top_hotspots(hotspots: DataFrame, k: int = 20) -> DataFrame:
    return hotspots.orderBy(F.desc("priority_score"), "stop_id").limit(k)


def equity_gaps(
    hotspots: DataFrame,
    vulnerability: DataFrame,
    stop_hour: DataFrame,
    params: Params = Params(),
    k: int = 20,
) -> DataFrame:
    """Stops with the highest priority that have both a vulnerability and recent events."""
    recent = (
        stop_hour.where(F.col(DATE_COLUMN) >= F.lit(_since(params, params.hotspot_window_days)))
        .groupBy("stop_id")
        .agg(((1 - F.avg("pct_on_time")) * 100).alias("reliability_score_0_100"))
    )
    return (
        hotspots.select("stop_id", "priority_score")
        .join(vulnerability.select("stop_id", "vuln_score_0_100"), "stop_id")
        .join(recent, "stop_id")
        .orderBy(F.desc("priority_score"), "stop_id")
        .limit(k)
    )


def filter_options(route_day: DataFrame) -> DataFrame:
    """Choices for the filters as (kind, value): routes, weather bins, first and last date."""
    routes = route_day.where("route_id is not null").select("route_id").distinct()
    bins = route_day.where("precip_bin is not null").select("precip_bin").distinct()
    span = route_day.agg(F.min(DATE_COLUMN).alias("lo"), F.max(DATE_COLUMN).alias("hi"))
    options = routes.select(F.lit("route").alias("kind"), F.col("route_id").alias("value"))
    return (
        options.union(bins.select(F.lit("precip_bin"), "precip_bin"))
        .union(
            span.select(
                F.inline(
                    F.array(
                        F.struct(F.lit("date_min"), F.col("lo").cast("string")),
                        F.struct(F.lit("date_max"), F.col("hi").cast("string")),
                    )
                )
            )
        )
    )


def freshness(marts: Mapping[str, DataFrame], params: Params = Params()) -> DataFrame:
    """Per mart: latest build in local time, latest service date, and the build's age in days."""
    parts = []
    for name, df in marts.items():
        built = F.max("build_run_at") if "build_run_at" in df.columns else F.lit(None)
        served = F.max(DATE_COLUMN) if DATE_COLUMN in df.columns else F.lit(None)
        parts.append(
            df.agg(
                F.lit(name).alias("mart"),
                built.cast("timestamp").alias("built"),
                served.cast("date").alias("latest_service_date"),
            )
        )
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    local = F.date_format(F.from_utc_timestamp("built", params.zone), "yyyy-MM-dd HH:mm")
    age = (F.unix_seconds(F.lit(params.now)) - F.unix_seconds("built")) / 86_400.0
    return together.select(
        "mart", local.alias("built_local"), "latest_service_date", age.alias("age_days")
    )
