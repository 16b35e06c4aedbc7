"""Data-quality checks: violations as rows (none means pass) or one summary row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.clock import local_date, local_hour
from stopwise.params import Params

# -- declared constraints ---------------------------------------------------------------


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relationship(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child keys, not missing, that the parent lacks."""
    keys = child.select(column).where(F.col(column).isNotNull())
    known = parent.select(F.col(key).alias(column)).distinct()
    return keys.join(known, column, "left_anti")


def accepted_range(
    df: DataFrame,
    column: str,
    low: float | None = None,
    high: float | None = None,
    exclusive_low: bool = False,
    exclusive_high: bool = False,
    severity: str = "error",
) -> DataFrame:
    """Values outside the range with the severity of the check; missing values pass."""
    value, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (value <= low if exclusive_low else value < low)
    if high is not None:
        bad = bad | (value >= high if exclusive_high else value > high)
    return df.where(bad).select(value.alias("value"), F.lit(severity).alias("severity"))


def column_contract(
    df: DataFrame,
    columns: Sequence[str],
    may_be_empty: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Broken promises of a drop as (rule, column_name): column set, types, empty columns."""
    spark = df.sparkSession
    found = dict(df.dtypes)
    broken = [("missing", c) for c in columns if c not in found]
    broken += [("unexpected", c) for c in df.columns if c not in columns]
    broken += [("repeated", c) for c in {c for c in df.columns if df.columns.count(c) > 1}]
    broken += [("type", c) for c, t in (types or {}).items() if found.get(c) not in (None, t)]
    static = spark.createDataFrame(broken, "rule string, column_name string")
    tested = [c for c in columns if c in found and c not in may_be_empty]
    if not tested:
        return static
    empty = df.agg(
        F.array(
            *[F.when(F.count(c) == 0, F.lit(c)) for c in tested]
        ).alias("c")
    ).select(
        F.lit("all null").alias("rule"), F.explode(F.array_compact("c")).alias("column_name")
    )
    return static.unionByName(empty)


def manifest_mismatch(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Files whose manifest entry has no hash or another row count than the file itself.

    ``rows`` carries ``_drop`` and ``_name`` of the file each row came from.
    """
    counted = rows.groupBy(F.col("_drop").alias("drop"), F.col("_name").alias("name")).agg(
        F.count(F.lit(1)).alias("found")
    )
    return listed.join(counted, ["drop", "name"], "left").where(
        "coalesce(found, 0) != row_count or coalesce(hash_md5, '') = ''"
    )


def duplicate_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Groups, groups with duplicates, most rows of one key, and total rows."""
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.expr("count_if(n > 1) as groups_with_duplicates"),
        F.max("n").alias("max_rows"),
        F.sum("n").alias("total_rows"),
    )


def grade(value: Column, passing: float, *warnings: float, fail: bool = True) -> Column:
    """PASS at or above the first threshold, WARN at or above a further one, else FAIL.

    Without ``fail`` the lowest grade is WARN.
    """
    ladder = F.when(value >= passing, "PASS")
    for threshold in warnings:
        ladder = ladder.when(value >= threshold, "WARN")
    return ladder.otherwise("FAIL" if fail else "WARN")


# -- realtime feed ----------------------------------------------------------------------


def _on(df: DataFrame, day: date, params: Params) -> DataFrame:
    return df.where(local_date("feed_ts_utc", params.zone) == F.lit(day))


def snapshot_counts(updates: DataFrame, day: date, params: Params = Params()) -> DataFrame:
    """Snapshots and rows of a local day, graded against one snapshot per five minutes."""
    stats = _on(updates, day, params).agg(
        F.countDistinct("feed_ts_utc").alias("num_snapshots"),
        F.count(F.lit(1)).alias("total_updates"),
    )
    return stats.withColumn("grade", grade(F.col("num_snapshots"), 280, 200, 80))


def vehicle_counts(positions: DataFrame, day: date, params: Params = Params()) -> DataFrame:
    stats = _on(positions, day, params).agg(
        F.count(F.lit(1)).alias("total_positions"),
        F.countDistinct("vehicle_id").alias("unique_vehicles"),
        F.countDistinct("feed_ts_utc").alias("num_snapshots"),
    )
    return stats.withColumn(
        "grade", F.when(F.col("total_positions") > 50_000, "PASS").otherwise("WARN")
    )


def daily_trend(updates: DataFrame, params: Params = Params(), days: int = 7) -> DataFrame:
    """Snapshots and rows per local day over the last days."""
    recent = updates.where(
        F.col("feed_ts_utc") >= F.lit(params.now) - F.expr(f"interval {days} days")
    )
    return recent.groupBy(local_date("feed_ts_utc", params.zone).alias("date_mst")).agg(
        F.countDistinct("feed_ts_utc").alias("snapshots"),
        F.count(F.lit(1)).alias("trip_updates"),
    )


def missing_hours(updates: DataFrame, day: date, params: Params = Params()) -> DataFrame:
    """Local hours of a day without a snapshot."""
    hours = updates.sparkSession.range(24).select(
        F.col("id").cast("int").alias("missing_hour_mst")
    )
    seen = _on(updates, day, params).select(
        local_hour("feed_ts_utc", params.zone).alias("missing_hour_mst")
    )
    return hours.join(seen.distinct(), "missing_hour_mst", "left_anti")


def missing_windows(
    updates: DataFrame, first: datetime, last: datetime, minutes: int = 5
) -> DataFrame:
    """Starts of the fixed-length windows between two instants without a snapshot."""
    step = minutes * 60
    lo, hi = int(first.timestamp()) // step, int(last.timestamp()) // step
    grid = updates.sparkSession.range(lo, hi + 1).select(F.col("id").alias("slot"))
    slots = updates.where(
        F.col("feed_ts_utc").between(F.lit(first), F.lit(last))
    ).select(F.expr(f"unix_seconds(feed_ts_utc) div {step}").alias("slot"))
    absent = grid.join(slots.distinct(), "slot", "left_anti")
    return absent.select(F.timestamp_seconds(F.col("slot") * step).alias("missing_from"))


def events_freshness(events: DataFrame, params: Params = Params(), hours: int = 2) -> DataFrame:
    """Newest snapshot of the last hours in local time, its age in minutes, and what it holds."""
    now = F.lit(params.now)
    recent = events.where(F.col("feed_ts_utc") >= now - F.expr(f"interval {hours} hours"))
    return (
        recent.agg(
            F.max("feed_ts_utc").alias("latest"),
            F.countDistinct("trip_id").alias("unique_trips"),
            F.countDistinct("route_id").alias("unique_routes"),
            F.count(F.lit(1)).alias("total_events"),
        )
        .withColumn("now", now)
        .select(
            F.from_utc_timestamp("latest", params.zone).alias("latest_snapshot_mst"),
            F.expr("timestampdiff(MINUTE, latest, now)").alias("minutes_ago"),
            "unique_trips",
            "unique_routes",
            "total_events",
        )
    )


# -- weather ----------------------------------------------------------------------------


def weather_coverage(
    weather: DataFrame, params: Params = Params(), oldest: int = 30, newest: int | None = None
) -> DataFrame:
    """Coverage of a span of days before today: last date, lag, days, and complete share."""
    span = weather.where(F.col("date") >= F.lit(params.days_ago(oldest)))
    if newest is not None:
        span = span.where(F.col("date") <= F.lit(params.days_ago(newest)))
    stats = span.agg(
        F.max("date").alias("latest_date"),
        F.countDistinct("date").alias("days_covered"),
        F.count("precip_mm").alias("days_with_precip"),
        F.count(F.lit(1)).alias("n"),
    )
    complete = F.round(F.col("days_with_precip") / F.nullif("n", F.lit(0)) * 100, 1)
    return stats.select(
        "latest_date",
        F.datediff(F.lit(params.today), "latest_date").alias("days_behind"),
        "days_covered",
        "days_with_precip",
        complete.alias("pct_complete"),
        grade(F.col("days_covered"), 25, fail=False).alias("grade_days"),
        grade(F.coalesce(complete, F.lit(0.0)), 70, 50, 20, fail=False).alias("grade_complete"),
    )


def weather_loads(weather: DataFrame, params: Params = Params(), days: int = 30) -> DataFrame:
    """Newest load per weather date, its distance from today, and rows with precipitation."""
    recent = weather.where(F.col("date") >= F.lit(params.days_ago(days)))
    return recent.groupBy("date").agg(
        F.max("_ingested_at").alias("latest_ingest"),
        F.datediff(F.lit(params.today), "date").alias("days_ago"),
        F.count("precip_mm").alias("with_precip"),
    )


def bin_rank(column: str = "precip_bin") -> Column:
    # The order in which the bins are shown.
    return F.expr(
        f"case {column} when 'none' then 1 when 'light' then 2 when 'mod' then 3 "
        "when 'heavy' then 4 end"
    )


def bin_share(weather: DataFrame, params: Params = Params(), days: int = 90) -> DataFrame:
    """Rows and share of each precipitation bin, driest first."""
    recent = weather.where(
        (F.col("date") >= F.lit(params.days_ago(days))) & F.col("precip_bin").isNotNull()
    )
    counts = recent.groupBy("precip_bin").agg(F.count(F.lit(1)).alias("num_days"))
    total = recent.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.round(F.col("num_days") / total * 100, 1)
    return counts.withColumn("pct_of_days", share).orderBy(bin_rank())


def bin_diversity(weather: DataFrame, params: Params = Params(), days: int = 90) -> DataFrame:
    recent = weather.where(F.col("date") >= F.lit(params.days_ago(days)))
    stats = recent.agg(F.countDistinct("precip_bin").alias("num_bins"))
    return stats.withColumn("grade", grade(F.col("num_bins"), 3, fail=False))


# -- marts ------------------------------------------------------------------------------


def mart_overview(route_day: DataFrame) -> DataFrame:
    stats = route_day.agg(
        F.min("service_date_mst").alias("first_date"),
        F.max("service_date_mst").alias("last_date"),
        F.countDistinct("service_date_mst").alias("transit_days"),
        F.countDistinct("route_id").alias("unique_routes"),
        F.round(F.avg("pct_on_time") * 100, 1).alias("avg_on_time_pct"),
    )
    return stats.withColumn(
        "grade", grade(F.col("transit_days"), 30, 1)
    )


def impact_summary(impacts: DataFrame) -> DataFrame:
    """Routes, mean on-time percent and mean change in points per bin, driest first."""
    return (
        impacts.groupBy("precip_bin")
        .agg(
            F.countDistinct("route_id").alias("routes_analyzed"),
            F.round(F.avg("pct_on_time_avg") * 100, 1).alias("avg_on_time_pct"),
            F.round(F.avg("delta_pct_on_time") * 100, 1).alias("avg_impact_pct_points"),
        )
        .orderBy(bin_rank())
    )


def coverage_by_date(route_day: DataFrame) -> DataFrame:
    return route_day.groupBy("service_date_mst").agg(
        F.countDistinct("route_id").alias("routes"), F.count(F.lit(1)).alias("records")
    )


def accumulation(route_day: DataFrame, weather: DataFrame, weather_from: date) -> DataFrame:
    """First and last date and day count of transit and weather data; rainy days for weather."""
    transit = route_day.agg(
        F.lit("Transit Data").alias("source"),
        F.min("service_date_mst").alias("first_date"),
        F.max("service_date_mst").alias("last_date"),
        F.countDistinct("service_date_mst").alias("total_days"),
    )
    observed = weather.where(F.col("date") >= F.lit(weather_from)).agg(
        F.lit("Weather Data").alias("source"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("date").alias("total_days"),
        F.expr("count_if(precip_bin != 'none') as rainy_days"),
    )
    return transit.unionByName(observed, allowMissingColumns=True)


def copies_agree(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two copies of a mart end on the same date, and how far their row counts differ."""

    def summary(df: DataFrame) -> Column:
        return df.agg(
            F.struct(
                F.max("service_date_mst").alias("latest"), F.count(F.lit(1)).alias("n")
            ).alias("s")
        ).scalar()

    both = left.sparkSession.range(1).select(summary(left).alias("l"), summary(right).alias("r"))
    diff = F.expr("abs(l.n - r.n) * 100 div nullif(l.n, 0)")
    return both.select(
        F.expr("l.latest as left_date"),
        F.expr("r.latest as right_date"),
        F.expr("l.latest <=> r.latest as same_date"),
        diff.alias("pct_diff"),
        F.when(~F.expr("l.latest <=> r.latest"), "WARN")
        .when(diff <= 5, "PASS")
        .when(diff <= 20, "ACCEPTABLE")
        .otherwise("WARN")
        .alias("grade"),
    )
