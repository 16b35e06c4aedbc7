"""Distances and clipped lengths on the earth.

Arguments are column names or SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions.steps import computed

# Fixed values.
EARTH_RADIUS_M = 6_371_008.8
MERCATOR_RADIUS_M = 6_378_137.0
DEG = math.pi / 180.0
METERS_PER_DEGREE = EARTH_RADIUS_M * DEG


def point(lon: str, lat: str) -> Column:
    """Point struct, NULL when a coordinate is missing."""
    return F.expr(
        f"case when {lon} is not null and {lat} is not null then "
        f"struct(cast({lon} as double) as lon, cast({lat} as double) as lat) end"
    )


def chord(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    """Two-vertex line struct."""
    return F.expr(
        f"struct(cast({lon1} as double) as lon1, cast({lat1} as double) as lat1, "
        f"cast({lon2} as double) as lon2, cast({lat2} as double) as lat2)"
    )


def haversine_m(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    """Great-circle distance in metres on the sphere."""
    half = f"{DEG / 2!r}D"
    return F.expr(
        f"{2 * EARTH_RADIUS_M!r}D * asin(least(1D, sqrt("
        f"pow(sin(({lat2} - {lat1}) * {half}), 2) + cos({lat1} * {DEG!r}D) "
        f"* cos({lat2} * {DEG!r}D) * pow(sin(({lon2} - {lon1}) * {half}), 2))))"
    )


def with_plane_scale(df: DataFrame) -> DataFrame:
    """Add ``_kx``: metres per degree of longitude at ``lat``."""
    return df.selectExpr("*", f"{METERS_PER_DEGREE!r}D * cos(lat * {DEG!r}D) as _kx")


def with_plane_chord(df: DataFrame) -> DataFrame:
    """Add the chord ``lon1, lat1, lon2, lat2`` in metres around ``lon, lat``.

    It needs ``_kx``. Start ``_x1, _y1``, direction ``_dx, _dy``, squared length ``_a`` (NULL when zero) and the
    start's component along the direction ``_b``.
    """
    ends = {
        "_x1": "(lon1 - lon) * _kx",
        "_y1": f"(lat1 - lat) * {METERS_PER_DEGREE!r}D",
        "_x2": "(lon2 - lon) * _kx",
        "_y2": f"(lat2 - lat) * {METERS_PER_DEGREE!r}D",
    }
    return (
        df.selectExpr("*", *[f"{v} as {k}" for k, v in ends.items()])
        .selectExpr("*", "_x2 - _x1 as _dx", "_y2 - _y1 as _dy")
        .selectExpr(
            "*", "nullif(_dx * _dx + _dy * _dy, 0D) as _a", "_x1 * _dx + _y1 * _dy as _b"
        )
    )


PLANE_COLUMNS = ("_kx", "_x1", "_y1", "_x2", "_y2", "_dx", "_dy", "_a", "_b")


def with_chord_in_disc(df: DataFrame, radius_m: float, output: str) -> DataFrame:
    """Length of the part of a chord inside the disc around a point, for each row.

    The position along the chord runs from 0 to 1; it is inside between the two roots of a
    quadratic.
    """
    middle = with_plane_chord(with_plane_scale(df)).selectExpr(
        "*", "-_b / _a as _mid", f"_x1 * _x1 + _y1 * _y1 - {radius_m * radius_m!r}D as _c"
    )
    roots = middle.selectExpr("*", "sqrt(greatest(_mid * _mid - _c / _a, 0D)) as _half")
    length = F.expr(
        "coalesce(greatest(least(1D, _mid + _half) - greatest(0D, _mid - _half), 0D) "
        "* sqrt(_a), 0D)"
    )
    return computed(roots, **{output: length}).drop(*PLANE_COLUMNS, "_mid", "_c", "_half")


# SQL text over the columns of with_plane_chord.
EDGE_DISTANCE_M2 = (
    "pow(_x1 + greatest(0D, least(1D, coalesce(-_b / _a, 0D))) * _dx, 2)"
    " + pow(_y1 + greatest(0D, least(1D, coalesce(-_b / _a, 0D))) * _dy, 2)"
)


def mercator_lon(x: str) -> str:
    """SQL text: longitude of a web-mercator easting."""
    return f"degrees({x} / {MERCATOR_RADIUS_M}D)"


def mercator_lat(y: str) -> str:
    """SQL text: latitude of a web-mercator northing."""
    return f"degrees(2 * atan(exp({y} / {MERCATOR_RADIUS_M}D)) - pi() / 2)"


# GRS80 ellipsoid, transverse-Mercator zone 13 north.
GRS80_A = 6_378_137.0
GRS80_F = 1 / 298.257222101
UTM_SCALE = 0.9996
UTM_ZONE13_MERIDIAN = -105.0
UTM_FALSE_EASTING = 500_000.0


# Half the third flattening and the series of the projection.
_N = GRS80_F / (2 - GRS80_F)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_UTM_RADIUS = UTM_SCALE * (GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64))


def _conformal(sin_phi: Column) -> Column:
    ecc = 2 * math.sqrt(_N) / (1 + _N)
    return F.sinh(F.atanh(sin_phi) - F.atanh(sin_phi * ecc) * ecc)


def _on_sphere(conformal: Column, lam: Column) -> tuple[Column, Column]:
    xi = F.atan2(conformal, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(conformal * conformal + 1))
    return xi, eta


def _on_plane(xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return east * _UTM_RADIUS + UTM_FALSE_EASTING, north * _UTM_RADIUS


def utm13(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres by the third-order Krueger series (mm accurate)."""
    lam = F.radians(lon - UTM_ZONE13_MERIDIAN)
    return _on_plane(*_on_sphere(_conformal(F.sin(F.radians(lat))), lam))


def utm13_path(vertices: str) -> Column:
    """``utm13`` of an array of [lon, lat], as an array of ``struct<e,n>``.

    A function over an array is interpreted, and a part of it that occurs twice is computed twice.
    So each step of the projection is a pass of its own over the vertices.
    """

    def named(names: str, *columns: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(columns, names.split(), strict=True)])

    angles = F.transform(
        vertices,
        lambda v: named("s lam", F.sin(F.radians(v[1])), F.radians(v[0] - UTM_ZONE13_MERIDIAN)),
    )
    conformal = F.transform(angles, lambda p: named("t lam", _conformal(p["s"]), p["lam"]))
    sphere = F.transform(conformal, lambda p: named("xi eta", *_on_sphere(p["t"], p["lam"])))
    return F.transform(sphere, lambda p: named("e n", *_on_plane(p["xi"], p["eta"])))
