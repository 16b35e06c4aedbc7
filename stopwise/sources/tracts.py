"""Landed tract features to rows with GeoJSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACT_FEATURE = """attributes map<string, string>,
    geometry struct<rings: array<array<array<double>>>>"""

# Names under which the layers publish each field, best first.
FIELDS = {
    "geoid": ("GEOID", "GEOID20", "geoid", "GEOID10"),
    "name": ("NAME", "NAMELSAD", "NAMELSAD20", "name"),
    "aland_m2": ("ALAND", "ALAND20", "AREA_LAND", "AREALAND"),
    "awater_m2": ("AWATER", "AWATER20", "AREA_WATER", "AREAWATER"),
    "state": ("STATEFP", "STATEFP20", "STATE", "STATE_FIPS"),
    "county": ("COUNTYFP", "COUNTYFP20", "COUNTY", "COUNTY_FIPS"),
}
STATE_FIPS, COUNTY_FIPS = "08", "031"


def field(candidates: Sequence[str], source: str = "attributes") -> Column:
    """Value under the first of the candidate names that is present and not empty."""
    return F.expr(
        "coalesce(" + ", ".join(f"nullif({source}['{c}'], '')" for c in candidates) + ")"
    )


def rings_to_geojson(rings: str) -> Column:
    """Polygon or MultiPolygon text of a list of rings; NULL when no ring has four points.

    A clockwise ring (or the first one) opens a new part, any other is a hole of the part before
    it. In the text outer rings run counter-clockwise and holes clockwise.
    """
    area = (
        "aggregate(sequence(0, size(r) - 2), 0D, (t, i) -> "
        "t + r[i][0] * r[i + 1][1] - r[i + 1][0] * r[i][1]) / 2"
    )
    measured = (
        f"transform(filter({rings}, r -> size(r) >= 4), r -> struct({area} as area, r as ring))"
    )
    turned = (
        "if(x.ring[0] = element_at(x.ring, -1), reverse(x.ring), "
        "concat(reverse(x.ring), slice(x.ring, size(x.ring), 1)))"
    )
    as_outer = f"if(x.area < 0, {turned}, x.ring)"
    as_hole = f"if(x.area > 0, {turned}, x.ring)"
    point_array = "array<array<array<array<double>>>>"
    parts = (
        f"aggregate({measured}, cast(array() as {point_array}), (parts, x) -> "
        "if(x.area <= 0 or size(parts) = 0, "
        f"concat(parts, array(array({as_outer}))), "
        "concat(slice(parts, 1, size(parts) - 1), "
        f"array(concat(element_at(parts, -1), array({as_hole}))))))"
    )
    return F.expr(
        f"transform(array({parts}), p -> case size(p) when 0 then null "
        "when 1 then '{\"type\":\"Polygon\",\"coordinates\":' || to_json(p[0]) || '}' "
        "else '{\"type\":\"MultiPolygon\",\"coordinates\":' || to_json(p) || '}' end)[0]"
    )


def county_features(
    features: DataFrame, state: str = STATE_FIPS, county: str = COUNTY_FIPS
) -> DataFrame:
    """Features of one county; a layer without the field is not filtered by it."""
    kept = features
    for name, value in (("state", state), ("county", county)):
        found = field(FIELDS[name])
        kept = kept.where(found.isNull() | (found == value))
    return kept


def _fields(features: DataFrame) -> DataFrame:
    named = {n: field(FIELDS[n]) for n in ("geoid", "name", "aland_m2", "awater_m2")}
    return features.select(
        *[c.alias(n) for n, c in named.items()],
        rings_to_geojson("geometry.rings").alias("geometry_geojson"),
    ).where("geoid is not null")


def tracts(features: DataFrame) -> DataFrame:
    """Tracts with a geometry; a missing name falls back to the id."""
    return _fields(features).where("geometry_geojson is not null").select(
        "geoid",
        F.coalesce("name", "geoid").alias("name"),
        F.col("aland_m2").try_cast("decimal(38,9)").alias("aland_m2"),
        F.col("awater_m2").try_cast("decimal(38,9)").alias("awater_m2"),
        "geometry_geojson",
    )


def tract_quality(features: DataFrame) -> DataFrame:
    return _fields(features).agg(
        F.count("geometry_geojson").alias("total"),
        F.expr("count_if(geometry_geojson is null) as missing_geometry"),
    )
