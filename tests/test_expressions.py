import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.functions.clock import (
    date_spine,
    local_date,
    local_hour,
    parse_yyyymmdd,
    service_instant,
    service_seconds,
)
from stopwise.functions.safe import flag, ratio
from tests.conftest import rows

ZONE = "America/Denver"


@pytest.mark.parametrize(
    ("day", "text", "expected"),
    [
        ("2025-01-10", "08:30:00", "2025-01-10 15:30:00"),
        ("2025-01-10", "25:10:00", "2025-01-11 08:10:00"),
        ("2025-01-10", "48:00:05", "2025-01-12 07:00:05"),
        ("2025-07-10", "08:30:00", "2025-07-10 14:30:00"),
        ("2025-03-09", "02:30:00", "2025-03-09 09:30:00"),  # skipped hour
        ("2025-11-02", "01:30:00", "2025-11-02 07:30:00"),  # repeated hour, first time
        ("2025-01-10", "8:30", None),
        ("2025-01-10", "08:61:00", None),
        ("2025-01-10", "xx:00:00", None),
        ("2025-01-10", "", None),
        ("2025-01-10", None, None),
    ],
)
def test_service_clock(spark, day, text, expected):
    df = spark.createDataFrame([(date.fromisoformat(day), text)], "d date, t string")
    at = service_instant("d", "s", ZONE)
    found = df.withColumn("s", service_seconds("t")).select(at.cast("string")).first()[0]
    assert found == expected


def test_local_parts_at_midnight_and_clock_changes(spark):
    df = spark.sql(
        """select explode(array(timestamp '2025-01-10 06:59:59', timestamp '2025-01-10 07:00:00',
           timestamp '2025-03-09 08:59:59', timestamp '2025-03-09 09:00:00',
           timestamp '2025-11-02 07:30:00', timestamp '2025-11-02 08:30:00')) as ts"""
    )
    found = df.select(local_date("ts", ZONE).cast("string"), local_hour("ts", ZONE)).collect()
    assert [tuple(r) for r in found] == [
        ("2025-01-09", 23), ("2025-01-10", 0), ("2025-03-09", 1), ("2025-03-09", 3),
        ("2025-11-02", 1), ("2025-11-02", 1),
    ]


def test_local_parts_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp '2025-01-10 06:59:59Z' as ts")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = spark.sql("select timestamp '2025-01-10 06:59:59Z' as ts").select(
            local_date("ts", ZONE).cast("string"), local_hour("ts", ZONE)
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2025-01-09", 23)
    assert df.count() == 1


def test_dates(spark):
    df = spark.createDataFrame([("20250131",), ("20250132",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_yyyymmdd("t")).collect()] == [
        date(2025, 1, 31), None, None, None,
    ]
    spine = date_spine(spark, date(2025, 1, 4), date(2025, 1, 6))
    assert rows(spine, "day_of_week", "is_sunday", "is_monday") == [
        ("monday", False, True), ("saturday", False, False), ("sunday", True, False),
    ]


def test_flag_and_ratio(spark):
    texts = [None, "", "0", "-2", "TRUE", " t ", "yes", "no", "2.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(flag(F.col("t"))).collect()] == [0, 0, 0, 1, 1, 1, 1, 0, 0]
    nums = spark.createDataFrame([(1, 3), (1, 0), (1, None), (1, -2)], "a int, b int")
    found = [r[0] for r in nums.select(ratio(F.col("a"), F.col("b"), 4)).collect()]
    assert found == [0.3333, None, None, None]


def test_projection_agrees_with_the_sphere(spark):
    e1, n1 = geo.utm13(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame([(-105.0, 39.7), (-104.99, 39.7), (-105.0, 39.71)], "lon double, lat double")
    found = [tuple(r) for r in df.select(e1, n1).collect()]
    assert found[0][0] == pytest.approx(500000, abs=1e-6)
    assert found[0][1] == pytest.approx(4394420.6, abs=60)
    east = found[1][0] - found[0][0]
    north = found[2][1] - found[0][1]
    sphere = math.radians(0.01) * geo.EARTH_RADIUS_M
    assert east == pytest.approx(sphere * math.cos(math.radians(39.7)), rel=4e-3)
    assert north == pytest.approx(sphere, rel=4e-3)


def test_mercator_inverse(spark):
    row = spark.range(1).selectExpr(
        f"{geo.mercator_lon('-11688546.533D')} as lon", f"{geo.mercator_lat('4825922.777D')} as lat"
    ).first()
    assert row.lon == pytest.approx(-105.0, abs=1e-6)
    assert row.lat == pytest.approx(39.7234, abs=1e-2)


def _chord(spark, chords, radius):
    df = spark.createDataFrame(
        [(-105.0, 39.7, *[c / geo.METERS_PER_DEGREE for c in xy]) for xy in chords],
        "lon double, lat double, a double, b double, c double, d double",
    ).selectExpr(
        "lon", "lat", f"lon + a / cos(radians(lat)) as lon1", "lat + b as lat1",
        "lon + c / cos(radians(lat)) as lon2", "lat + d as lat2",
    )
    return [r[0] for r in geo.with_chord_in_disc(df, radius, "m").select("m").collect()]


def test_chord_in_disc_cases(spark):
    found = _chord(
        spark,
        [
            (-500, 0, 500, 0),  # through the centre
            (-50, 10, 50, 10),  # inside
            (300, 0, 500, 0),  # outside
            (-500, 200.0001, 500, 200.0001),  # misses
            (0, 0, 0, 0),  # no length
            (0, 0, 400, 0),  # leaves
        ],
        200,
    )
    assert found == pytest.approx([400, 100, 0, 0, 0, 200], abs=1e-4)


def test_chord_in_disc_against_sampling(spark):
    rng = random.Random(7)
    chords = [tuple(rng.uniform(-400, 400) for _ in range(4)) for _ in range(40)]
    for (x1, y1, x2, y2), found in zip(chords, _chord(spark, chords, 200), strict=True):
        steps = 4000
        inside = sum(
            math.hypot(x1 + (x2 - x1) * (i + 0.5) / steps, y1 + (y2 - y1) * (i + 0.5) / steps) <= 200
            for i in range(steps)
        )
        assert found == pytest.approx(inside / steps * math.hypot(x2 - x1, y2 - y1), abs=0.5)
