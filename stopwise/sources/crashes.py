"""Landed crash features to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.functions.safe import flag, ratio
from stopwise.sources.realtime import inside_area

CRASH_FEATURE = """attributes struct<incident_id: string, first_occurrence_date: string,
    top_traffic_accident_offense: string, incident_address: string, geo_lat: string,
    geo_lon: string, POINT_X: string, POINT_Y: string, bicycle_ind: string,
    pedestrian_ind: string, SERIOUSLY_INJURED: string, FATALITIES: string>,
    geometry struct<x: double, y: double>"""

# The area of the city.
CITY_AREA = {"lon": (-105.2, -104.5), "lat": (39.4, 40.2)}


def severity(text: str, seriously_injured: str, fatalities: str) -> Column:
    """Struct of severity text and rank: casualty counts first, then words in the offence."""
    label = f"lower(trim(coalesce({text}, '')))"
    # Texts and ranks.
    return F.expr(
        f"""case
        when try_cast({fatalities} as bigint) > 0
            then named_struct('severity_text', 'fatal', 'severity', 4L)
        when try_cast({seriously_injured} as bigint) > 0
            then named_struct('severity_text', 'serious_injury', 'severity', 3L)
        when contains({label}, 'sbi')
            then named_struct('severity_text', 'serious_injury', 'severity', 3L)
        when contains({label}, 'injury')
            then named_struct('severity_text', 'injury', 'severity', 2L)
        when contains({label}, 'fatal')
            then named_struct('severity_text', 'fatal', 'severity', 4L)
        else named_struct('severity_text', 'property_damage', 'severity', 1L) end"""
    )


def address_parts(address: str) -> Column:
    """Struct of roadway, on and off: split at the first `` / ``, else the first `` & ``."""
    clean = f"nullif(trim({address}), '')"
    mark = f"case when contains({clean}, ' / ') then ' / ' when contains({clean}, ' & ') then ' & ' end"
    at = f"instr({clean}, {mark})"
    return F.expr(
        f"""named_struct(
        'roadway_name', {clean},
        'on_route', case when {mark} is null then {clean}
                         else nullif(trim(substring({clean}, 1, {at} - 1)), '') end,
        'off_route', nullif(trim(substring({clean}, {at} + 3)), ''))"""
    )


def coordinates(
    lat: str, lon: str, point_y: str, point_x: str, x: str, y: str
) -> Column:
    """Struct of lat and lon from the first complete pair; map coordinates come last."""
    pairs = [(f"try_cast({a} as double)", f"try_cast({b} as double)") for a, b in
             ((lat, lon), (point_y, point_x))]
    pairs.append((geo.mercator_lat(y), geo.mercator_lon(x)))
    branches = " ".join(
        f"when {a} is not null and {b} is not null "
        f"then named_struct('lat', {a}, 'lon', {b})"
        for a, b in pairs
    )
    return F.expr(f"case {branches} end")


def epoch_millis(value: str) -> Column:
    """Instant cut to the second; NULL for anything but whole milliseconds."""
    return F.expr(f"timestamp_seconds(floor(try_cast({value} as bigint) / 1000))")


def crash_rows(features: DataFrame) -> DataFrame:
    """All crashes of a drop, before any is dropped."""
    a = "attributes"
    rows = features.select(
        F.nullif(F.col(f"{a}.incident_id"), F.lit("")).alias("crash_id"),
        epoch_millis(f"{a}.first_occurrence_date").alias("event_ts_utc"),
        severity(
            f"{a}.top_traffic_accident_offense", f"{a}.SERIOUSLY_INJURED", f"{a}.FATALITIES"
        ).alias("s"),
        coordinates(
            f"{a}.geo_lat", f"{a}.geo_lon", f"{a}.POINT_Y", f"{a}.POINT_X",
            "geometry.x", "geometry.y",
        ).alias("c"),
        address_parts(f"{a}.incident_address").alias("p"),
        flag(F.col(f"{a}.bicycle_ind")).cast("long").alias("bike_involved"),
        flag(F.col(f"{a}.pedestrian_ind")).cast("long").alias("ped_involved"),
    )
    return rows.selectExpr(
        "crash_id", "event_ts_utc", "s.severity", "s.severity_text", "c.lat", "c.lon",
        "p.roadway_name", "p.on_route", "p.off_route", "bike_involved", "ped_involved",
    )


UNPLACED = "(lat is null or lon is null) and roadway_name is null"


def crashes(features: DataFrame) -> DataFrame:
    """Crashes with a position or a roadway."""
    return crash_rows(features).where(f"not ({UNPLACED})")


def crash_quality(features: DataFrame) -> DataFrame:
    """Counts over all crashes of a drop, in one pass.

    The time success rate divides by the kept rows, as the drops' manifests do.
    """
    stats = crash_rows(features).agg(
        F.count(F.lit(1)).alias("total"),
        F.expr(f"count_if({UNPLACED}) as dropped_no_location"),
        F.expr("count(event_ts_utc) as timestamp_success"),
        F.expr("count_if(event_ts_utc is null) as timestamp_failures"),
        F.expr("count_if(lat is not null and lon is not null) as bbox_total"),
        F.expr(f"count_if({inside_area(CITY_AREA)}) as bbox_in"),
    )
    kept = F.col("total") - F.col("dropped_no_location")
    return stats.withColumns(
        {
            "timestamp_success_pct": F.coalesce(
                ratio(F.col("timestamp_success") * 100.0, kept), F.lit(0.0)
            ),
            "bbox_in_pct": F.coalesce(
                ratio(F.col("bbox_in") * 100.0, F.col("bbox_total")), F.lit(0.0)
            ),
        }
    )
