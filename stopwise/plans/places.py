"""Per-stop marts about places: crashes, sidewalks, people and the combined ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.functions.clock import utc_date
from stopwise.operators.scoring import dense_rank_desc, minmax_score
from stopwise.operators.spatial import (
    chord_lengths_within,
    points_near_polygons,
    points_within,
)
from stopwise.params import Params
from stopwise.sinks.tables import materialize

CRASH_COUNTS = (
    "crash_100m_cnt", "severe_100m_cnt", "fatal_100m_cnt", "crash_250m_cnt", "severe_250m_cnt",
    "fatal_250m_cnt",
)


def _placed(stops: DataFrame) -> DataFrame:
    return stops.select("stop_id", "geom.lon", "geom.lat")


def _locations(placed: DataFrame) -> DataFrame:
    """Distinct stop positions: stops in one place are measured once."""
    return placed.select("lon", "lat").where("lon is not null and lat is not null").distinct()


def _at_stops(placed: DataFrame, measured: DataFrame) -> DataFrame:
    """Stops with what was measured at their position, NULL when nothing was.

    Stops without a position get scattered keys beyond any longitude, so that they do not meet
    in one task.
    """
    keyed = placed.selectExpr(
        "stop_id",
        "coalesce(lon, 1000D + pmod(xxhash64(stop_id), 1000000)) as lon",
        "coalesce(lat, 0D) as lat",
    )
    return keyed.join(measured, ["lon", "lat"], "left")


def crash_points(crashes: DataFrame, params: Params = Params()) -> DataFrame:
    """Crashes of the window as counts per position.

    The window ends at the newest crash and includes both end dates, by UTC date. Crashes are
    geocoded to street addresses and crossings, so many share a position.
    """
    day = utc_date("event_ts_utc")
    newest = crashes.agg(F.max(day).alias("as_of_date")).scalar()
    recent = crashes.where(
        day.between(F.date_sub(newest, params.crash_window_days), newest)
    )
    return recent.groupBy(
        F.col("geom.lon").alias("r_lon"), F.col("geom.lat").alias("r_lat")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") >= 3).alias("n_severe"),
        F.count_if(F.col("severity") == 4).alias("n_fatal"),
    )


def crash_pairs(stops: DataFrame, crashes: DataFrame, params: Params = Params()) -> DataFrame:
    """Each stop with each crash of the window inside the outer radius, and the distance."""
    day = utc_date("event_ts_utc")
    newest = crashes.agg(F.max(day).alias("as_of_date")).scalar()
    recent = crashes.where(
        day.between(F.date_sub(newest, params.crash_window_days), newest)
    ).select(
        "crash_id",
        "event_ts_utc",
        "severity",
        F.col("geom.lon").alias("r_lon"),
        F.col("geom.lat").alias("r_lat"),
    )
    return points_within(_placed(stops), recent, params.crash_radius_m)


def crash_proximity_by_stop(
    stops: DataFrame, crashes: DataFrame, params: Params = Params()
) -> DataFrame:
    """Crash counts within the inner and outer radius of every stop."""
    placed = _placed(stops)
    near = points_within(_locations(placed), crash_points(crashes, params), params.crash_radius_m)
    close = F.col("distance_m") <= params.crash_inner_radius_m
    sums = []
    for label, inside in (("100m", close), ("250m", F.lit(True))):
        for kind, column in (("crash", "n"), ("severe", "n_severe"), ("fatal", "n_fatal")):
            counted = F.sum(F.when(inside, F.col(column)).otherwise(0))
            sums.append(counted.alias(f"{kind}_{label}_cnt"))
    counts = near.groupBy("lon", "lat").agg(*sums)
    as_of = crashes.agg(F.max(utc_date("event_ts_utc")).alias("as_of_date")).scalar()
    return _at_stops(placed, counts).select(
        "stop_id",
        as_of.alias("as_of_date"),
        F.lit(params.crash_window_days).alias("window_days"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in CRASH_COUNTS],
        F.lit(params.now).alias("build_run_at"),
    )


def sidewalk_length_by_stop(
    stops: DataFrame, sidewalks: DataFrame, params: Params = Params()
) -> DataFrame:
    """Metres of sidewalk chord inside the buffer of every stop, zero when none."""
    placed = _placed(stops)
    chords = sidewalks.groupBy("geom.lon1", "geom.lat1", "geom.lon2", "geom.lat2").agg(
        F.count(F.lit(1)).alias("copies")
    )
    inside = chord_lengths_within(
        _locations(placed), chords.dropna(), params.sidewalk_buffer_m
    )
    lengths = inside.groupBy("lon", "lat").agg(
        F.sum(F.col("inside_m") * F.col("copies")).alias("tot_len_m")
    )
    return _at_stops(placed, lengths).select(
        "stop_id",
        F.lit(int(params.sidewalk_buffer_m)).alias("buffer_m"),
        F.coalesce("tot_len_m", F.lit(0.0)).alias("sidewalk_len_m_within_200m"),
    )


def access_score_by_stop(
    stops: DataFrame, sidewalks: DataFrame, params: Params = Params()
) -> DataFrame:
    lengths = sidewalk_length_by_stop(stops, sidewalks, params)
    lengths = materialize(lengths, "access")  # read twice below, one row per stop
    scored = minmax_score(lengths, "sidewalk_len_m_within_200m", "access_score_0_100", 100.0)
    return scored.withColumn("build_run_at", F.lit(params.now))


SHARES = ("pct_hh_no_vehicle", "pct_transit_commute", "pct_poverty")


def tract_catchment(
    stops: DataFrame, tracts: DataFrame, params: Params = Params()
) -> DataFrame:
    """Each stop position with each tract inside the catchment distance."""
    return points_near_polygons(
        _locations(_placed(stops)), tracts, "geoid", params.tract_catchment_m
    )


def vulnerability_by_stop(
    stops: DataFrame, tracts: DataFrame, demographics: DataFrame, params: Params = Params()
) -> DataFrame:
    """Population-weighted shares of the tracts around each stop, and their mean scaled.

    A missing share adds nothing to its sum while the population still counts. Tracts without
    people take no part, so they are dropped before the distance join. What a tract adds to the sums
    goes along with its shape, and each task adds up the pairs of its stops: pairs are not shuffled.
    """
    people = (
        demographics.where("pop_total > 0")
        .select(
            F.regexp_replace("geoid", "^14000US", "").alias("geoid"),
            F.col("pop_total").cast("double").alias("w"),
            *[F.col(c).cast("double").alias(c) for c in SHARES],
        )
        .groupBy("geoid")
        .agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in SHARES], F.sum("w").alias("w"))
    )
    placed = _placed(stops)
    near = points_near_polygons(
        _locations(placed),
        tracts.select("geoid", "edges").join(people, "geoid"),
        "geoid",
        params.tract_catchment_m,
        carry=("w", *SHARES),
    )
    total = F.nullif(F.sum("w"), F.lit(0.0))
    means = near.groupBy("lon", "lat").agg(
        *[(F.sum(c) / total).alias(f"{c}_w") for c in SHARES]
    )
    weighted = [f"{c}_w" for c in SHARES]
    raw = sum((F.col(c) for c in weighted[1:]), F.col(weighted[0])) / 3.0
    joined = _at_stops(placed, means).select(
        "stop_id", *weighted, raw.alias("vuln_raw")
    )
    joined = materialize(joined, "vulnerability")  # read twice below, one row per stop
    scored = minmax_score(joined, "vuln_raw", "vuln_score_0_100", 100.0).drop("vuln_raw")
    return scored.withColumn("build_run_at", F.lit(params.now))


def unreliability_by_stop(stop_hour: DataFrame, params: Params = Params()) -> DataFrame:
    """100 minus the mean on-time share in percent over the hotspot window; high is worse."""
    since = params.days_ago(params.hotspot_window_days)
    return (
        stop_hour.where(F.col("service_date_mst") >= F.lit(since))
        .groupBy("stop_id")
        .agg(((1 - F.avg("pct_on_time")) * 100.0).alias("reliability_score_0_100"))
    )


def priority_hotspots(
    vulnerability: DataFrame,
    crash_proximity: DataFrame,
    stop_hour: DataFrame,
    params: Params = Params(),
) -> DataFrame:
    """Weighted blend of vulnerability, crash exposure and unreliability, ranked.

    The inputs have one row per stop, so the three-way full join is a union with one grouping.
    The score keeps nine decimals, so that equal blends tie whatever the order of summation.
    """
    crash = minmax_score(
        crash_proximity.select("stop_id", "crash_250m_cnt"),
        "crash_250m_cnt",
        "crash_score_0_100",
        None,
    )
    inputs = (
        vulnerability.select("stop_id", "vuln_score_0_100"),
        crash.select("stop_id", "crash_score_0_100"),
        unreliability_by_stop(stop_hour, params),
    )
    together = inputs[0]
    for other in inputs[1:]:
        together = together.unionByName(other, allowMissingColumns=True)
    scores = ["vuln_score_0_100", "crash_score_0_100", "reliability_score_0_100"]
    joined = (
        together.where("stop_id is not null")
        .groupBy("stop_id")
        .agg(*[F.max(c).alias(c) for c in scores])
    )
    parts = [
        F.coalesce(c, F.lit(0.0)) * weight
        for c, weight in zip(scores, params.hotspot_weights, strict=True)
    ]
    scored = joined.withColumn("priority_score", F.round(parts[0] + parts[1] + parts[2], 9))
    return dense_rank_desc(scored, "priority_score", "priority_rank").withColumn(
        "build_run_at", F.lit(params.now)
    )
