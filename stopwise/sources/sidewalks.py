"""Landed sidewalk features to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.functions.safe import clean_text, ratio, to_long

SIDEWALK_FEATURE = """attributes struct<OBJECTID: string, FACILITYID: string,
    SIDEWALKTYPE: string, SIDEWALKSTATUS: string, SURFACE: string, BUILTYEAR: string>,
    geometry struct<paths: array<array<array<double>>>>"""


def projected_length(vertices: str) -> Column:
    """Length in metres of the polyline through the vertices on the projected plane.

    Each vertex is projected once, and one pass over them carries the previous one; fewer than two
    give 0.
    """
    start = F.struct(
        F.lit(0.0).alias("e"), F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(True).alias("first")
    )

    def further(so_far: Column, v: Column) -> Column:
        step = F.sqrt(F.pow(v["e"] - so_far["e"], 2) + F.pow(v["n"] - so_far["n"], 2))
        total = F.when(so_far["first"], so_far["m"]).otherwise(so_far["m"] + step)
        return F.struct(
            v["e"].alias("e"), v["n"].alias("n"), total.alias("m"), F.lit(False).alias("first")
        )

    return F.aggregate(geo.utm13_path(vertices), start, further, lambda end: end["m"])


def sidewalks(features: DataFrame) -> DataFrame:
    """One row per feature with paths: ends, mean vertex and length over all its paths."""
    flat = features.select(
        "attributes", F.flatten("geometry.paths").alias("v")
    ).where("size(v) > 0")

    def mean(i: int) -> str:
        return f"aggregate(v, 0D, (t, p) -> t + p[{i}]) / size(v)"

    def text(name: str) -> Column:
        return clean_text(F.col(f"attributes.{name}"))

    identifier = F.coalesce(F.nullif(text("FACILITYID"), F.lit("")), text("OBJECTID"))
    return flat.select(
        identifier.alias("sidewalk_id"),
        text("SIDEWALKTYPE").alias("class"),
        text("SIDEWALKSTATUS").alias("status"),
        text("SURFACE").alias("material"),
        to_long(F.col("attributes.BUILTYEAR")).cast("string").alias("year_built"),
        F.expr("v[0][0]").alias("lon_start"),
        F.expr("v[0][1]").alias("lat_start"),
        F.expr("element_at(v, -1)[0]").alias("lon_end"),
        F.expr("element_at(v, -1)[1]").alias("lat_end"),
        projected_length("v").alias("length_m"),
        F.expr(mean(0)).alias("centroid_lon"),
        F.expr(mean(1)).alias("centroid_lat"),
    )


def network_quality(features: DataFrame, rows: DataFrame) -> DataFrame:
    """Segment count, share with a positive length in percent, and network length in km."""
    total = features.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = rows.agg(
        F.expr("count_if(length_m > 0) as positive"),
        F.expr("coalesce(sum(length_m), 0D) / 1000 as total_length_km"),
    )
    return stats.select(
        total.alias("segment_count"),
        F.coalesce(ratio(F.col("positive") * 100.0, total), F.lit(0.0)).alias(
            "positive_length_pct"
        ),
        "total_length_km",
    )
