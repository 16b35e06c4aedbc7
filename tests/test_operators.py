import math
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stopwise.functions import geo
from stopwise.operators.latest import first_in_order, newest, newest_partition
from stopwise.operators.nearest import nearest_in_time
from stopwise.operators.scoring import dense_rank_desc, minmax_score, share_of_total
from stopwise.operators.skew import join_splitting_hot_keys, never_matching
from stopwise.operators.spatial import (
    chord_lengths_within,
    points_near_polygons,
    points_within,
)
from stopwise.plans.staging import geojson_edges
from tests.conftest import ordered, rows


def test_latest_record_orders_nulls_last_and_breaks_ties(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", None, "z"), ("a", 2, "p"), ("a", 2, "q"), (None, 1, "n"), (None, 3, "m")],
        "k string, o int, v string",
    )
    assert rows(newest(df, ["k"], ["o"])) == ordered([("a", 2, "q"), (None, 3, "m")])
    assert rows(first_in_order(df, ["k"], ["o"])) == ordered([("a", None, "z"), (None, 1, "n")])


def test_newest_partition(spark):
    df = spark.createDataFrame(
        [(date(2025, 1, 1), 1), (date(2025, 1, 2), 2), (None, 3)], "_extract_date date, v int"
    )
    assert rows(newest_partition(df), "v") == [(2,)]


def test_never_matching_keeps_rows_apart(spark):
    df = spark.range(50).select(F.lit(None).cast("string").alias("k"), "id")
    keyed = df.select(never_matching(F.col("k"), F.col("id")).alias("j"))
    assert keyed.distinct().count() == 50
    other = spark.createDataFrame([("a",)], "j string")
    assert keyed.join(other, "j").count() == 0


def test_splitting_hot_keys_equals_the_plain_join(spark):
    big = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "id as v")
    small = spark.range(80).selectExpr("id % 60 as k", "id as w")
    plain = big.join(small, "k").groupBy("k", "v", "w").count()
    split = join_splitting_hot_keys(big, small, ["k"], ["v"], rows_per_split=40)
    split = split.groupBy("k", "v", "w").count()
    assert plain.exceptAll(split).count() == 0
    assert split.exceptAll(plain).count() == 0


def test_nearest_in_time_equals_brute_force(spark):
    rng = random.Random(3)
    base = datetime(2025, 1, 1, tzinfo=UTC)
    keys = ["a", "b", None, "only-left"]
    left = {(rng.choice(keys), base + timedelta(seconds=rng.randrange(4000))) for _ in range(300)}
    right = {
        (rng.choice(keys[:3]), base + timedelta(seconds=rng.randrange(4000))): rng.randrange(900)
        for _ in range(60)
    }
    found = nearest_in_time(
        spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k string, t timestamp, i int"),
        spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, s timestamp, v int"),
        ["k"], "t", "s", "v",
    )
    expected = []
    for i, (k, t) in enumerate(left):
        near = [(abs((t - s).total_seconds()), s, v) for (rk, s), v in right.items() if rk == k]
        if near:
            d, s, v = min(near, key=lambda n: (n[0], n[1]))
            expected.append((i, int(s.timestamp()), v, int(d)))
    got = found.select("i", F.unix_seconds("s"), "v", "dt_abs")
    assert rows(got) == ordered(expected)


def test_nearest_in_time_of_one_large_key(spark):
    """A frame that starts anew for every row would need minutes here."""
    n = 30_000
    left = spark.range(n).selectExpr("'k' as k", "timestamp_seconds(id * 3) as t", "id as i")
    right = spark.range(n).selectExpr("'k' as k", "timestamp_seconds(id * 3 + 1) as s", "id as v")
    found = nearest_in_time(left, right, ["k"], "t", "s", "v")
    wrong = found.where("not (dt_abs = 1 and v = i)")
    assert found.count() == n and wrong.isEmpty()


def test_many_hot_keys_are_all_split(spark):
    big = spark.range(60_000).selectExpr("id % 20000 as k", "id as v")
    small = spark.range(20_000).selectExpr("id as k", "id * 2 as w")
    joined = join_splitting_hot_keys(big, small, ["k"], ["v"], rows_per_split=2)
    assert joined.where("w = 2 * k").count() == 60_000


def test_minmax_scores(spark):
    def scores(values, flat):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return [r.s for r in minmax_score(df, "v", "s", flat).orderBy("v").collect()]

    assert scores([0.0, 5.0, 20.0], 100.0) == [0.0, 25.0, 100.0]
    assert scores([None, 4.0, 4.0], 100.0) == [100.0, 100.0, 100.0]
    assert scores([4.0, 4.0], None) == [None, None]
    assert scores([None, None], 100.0) == [None, None]
    assert scores([None, 1.0, 2.0], 100.0) == [None, 0.0, 100.0]


def test_dense_rank_equals_the_window(spark):
    rng = random.Random(5)
    values = [rng.choice([None, 3.25, rng.uniform(-20, 140), float(round(rng.uniform(0, 100)))]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    found = dense_rank_desc(df, "v", "r", buckets=16)
    assert found.count() == 400
    order = sorted({v for v in values if v is not None}, reverse=True)
    expected = {v: i + 1 for i, v in enumerate(order)} | {None: len(order) + 1}
    assert all(r.r == expected[r.v] for r in found.collect())


def test_share_of_total(spark):
    df = spark.createDataFrame([(1,), (3,)], "n int")
    assert sorted(r[0] for r in df.select(share_of_total(df, "n")).collect()) == [0.25, 0.75]


def _haversine(a, b):
    (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))


@pytest.mark.parametrize("south", [39.6, -0.01, 64.0])
def test_points_within_equals_brute_force(spark, south):
    rng = random.Random(11)

    def cloud(n):
        points = [(rng.uniform(-105.02, -104.98), south + rng.uniform(0, 0.03)) for _ in range(n)]
        return points + [points[0]] * 5

    left, right = cloud(60), cloud(200)
    found = points_within(
        spark.createDataFrame([(i, *p) for i, p in enumerate(left)], "i int, lon double, lat double"),
        spark.createDataFrame([(j, *p) for j, p in enumerate(right)], "j int, r_lon double, r_lat double"),
        250.0,
        rows_per_split=7,
    )
    expected = [
        (i, j) for i, a in enumerate(left) for j, b in enumerate(right) if _haversine(a, b) <= 250
    ]
    assert rows(found, "i", "j") == ordered(expected)


def test_long_chords_meet_every_point_they_pass(spark):
    rng = random.Random(13)
    points = [(rng.uniform(-105.2, -104.8), rng.uniform(39.5, 39.9)) for _ in range(150)]
    chords = [
        (-105.2, 39.5, -104.8, 39.9), (-105.0, 39.5, -105.0, 39.9), (-105.2, 39.7, -104.8, 39.7),
        (-104.9, 39.8, -105.1, 39.55), (-105.0, 39.7, -105.0, 39.7),
    ] + [(x, y, x + 0.001, y + 0.0005) for x, y in points[:40]]
    p = spark.createDataFrame([(i, *c) for i, c in enumerate(points)], "i int, lon double, lat double")
    c = spark.createDataFrame(
        [(j, *x) for j, x in enumerate(chords)],
        "j int, lon1 double, lat1 double, lon2 double, lat2 double",
    )
    brute = geo.with_chord_in_disc(p.crossJoin(c), 200.0, "inside_m").where("inside_m > 0")
    found = chord_lengths_within(p, c, 200.0, rows_per_split=3)
    assert rows(found.select("i", "j", F.round("inside_m", 6))) == rows(
        brute.select("i", "j", F.round("inside_m", 6))
    )
    assert found.count() > 40


def _polygons(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "geoid string, t string")
    return df.select("geoid", geojson_edges("t").alias("edges"))


def test_points_near_polygons(spark):
    side = 5000 / geo.METERS_PER_DEGREE
    lon, lat = -105.0, 39.7

    def box(x, y, w, closed=True):
        ring = [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]
        return ring + [[x, y]] if closed else ring

    outer, hole = box(lon, lat, side), box(lon + side * 0.25, lat + side * 0.25, side * 0.5)
    polygons = _polygons(
        spark,
        {
            "holed": str({"type": "Polygon", "coordinates": [outer, hole]}).replace("'", '"'),
            "open": str({"type": "Polygon", "coordinates": [box(lon, lat, side, False)]}).replace("'", '"'),
            "two": str(
                {"type": "MultiPolygon", "coordinates": [[outer], [box(lon + 1, lat, side)]]}
            ).replace("'", '"'),
            "none": "not json",
        },
    )
    meters = 1 / geo.METERS_PER_DEGREE
    spots = {
        "inside": (lon + side * 0.1, lat + side * 0.1),
        "in hole": (lon + side * 0.5, lat + side * 0.5),
        "804 south": (lon + side / 2, lat - 804 * meters),
        "806 south": (lon + side / 2, lat - 806 * meters),
        "second": (lon + 1 + side / 2, lat + side / 2),
        "far": (lon + 3, lat),
    }
    points = spark.createDataFrame([(n, *p) for n, p in spots.items()], "n string, lon double, lat double")
    near = points_near_polygons(points, polygons, "geoid", 804.672, rows_per_split=2)
    named = near.join(points, ["lon", "lat"]).select("n", "geoid")
    # The middle of the hole is 960 m from its nearest edge.
    assert rows(named) == ordered(
        [("inside", g) for g in ("holed", "open", "two")]
        + [("in hole", g) for g in ("open", "two")]
        + [("804 south", g) for g in ("holed", "open", "two")]
        + [("second", "two")]
    )


def test_a_polygon_of_many_edges_and_points_is_split(spark):
    """A circle of 2,000 edges: distances are known without the operator."""
    lat, n, radius = 39.7, 2_000, 3_000.0
    kx = math.cos(math.radians(lat))
    at = lambda r, t: (
        -105 + r * math.cos(t) / geo.METERS_PER_DEGREE / kx,
        lat + r * math.sin(t) / geo.METERS_PER_DEGREE,
    )
    ring = [list(at(radius, 2 * math.pi * i / n)) for i in range(n)]
    polygons = _polygons(spark, {"c": str({"type": "Polygon", "coordinates": [ring + ring[:1]]}).replace("'", '"')})
    reach = [(100.0 + 13 * i, 0.1 + i) for i in range(300)]
    points = spark.createDataFrame([(*at(r, t), r) for r, t in reach], "lon double, lat double, r double")
    found = points_near_polygons(points, polygons, "geoid", 500.0, rows_per_split=40).join(points, ["lon", "lat"])
    got = {round(x.r): x.distance_m for x in found.collect()}
    assert {round(r) for r, _ in reach if r < radius + 490} <= set(got) <= {round(r) for r, _ in reach if r < radius + 510}
    assert all(abs(d - max(0.0, r - radius)) < 10 for r, d in got.items())


def _inside(lon, lat, ring):
    sides = zip(ring, ring[1:] + ring[:1], strict=True)
    return sum(
        (y1 > lat) != (y2 > lat) and x1 + (lat - y1) / (y2 - y1) * (x2 - x1) > lon
        for (x1, y1), (x2, y2) in sides
    ) % 2 == 1


def test_jagged_polygons_of_many_cells_against_brute_force(spark):
    """Rings over many cells that cross themselves, have corners on borders of cells, and overlap."""
    rng = random.Random(5)
    step = 2_000.0 / geo.METERS_PER_DEGREE * 1.001
    rings = {}
    for p in range(6):
        around = sorted(rng.uniform(0, 2 * math.pi) for _ in range(40)) if p % 2 else [i * 2.4 for i in range(25)]
        ring = [(-105 + rng.uniform(0.02, 0.15) * math.cos(t), 39.7 + rng.uniform(0.02, 0.12) * math.sin(t)) for t in around]
        # Latitudes on the border of a row, and a level edge.
        ring[3:5] = [(ring[3][0], round(ring[3][1] / step) * step), (ring[4][0], round(ring[3][1] / step) * step)]
        rings[f"p{p}"] = ring
    polygons = _polygons(spark, {
        g: str({"type": "Polygon", "coordinates": [[list(x) for x in r]]}).replace("'", '"') for g, r in rings.items()
    })
    spots = [(rng.uniform(-105.2, -104.8), rng.uniform(39.55, 39.85)) for _ in range(400)]
    spots += [(x, round(y / step) * step) for x, y in spots[:60]]
    # In one latitude with level edges, and such edges may reach over the border of a cell.
    spots += [(x, ring[3][1]) for x, _ in spots[60:90] for ring in rings.values()]
    points = spark.createDataFrame(spots, "lon double, lat double")
    found = points_near_polygons(points, polygons, "geoid", 50.0)
    got = {(r.geoid, r.lon, r.lat) for r in found.collect() if r.distance_m < 1e-6}
    # A place on the level edge itself has the distance 0 too.
    level = {g: (*sorted((ring[3][0], ring[4][0])), ring[3][1]) for g, ring in rings.items()}
    on_it = {(g, x, y) for g, (w, e, at) in level.items() for x, y in spots if y == at and w <= x <= e}
    expected = {(g, *s) for g, ring in rings.items() for s in spots if _inside(*s, ring)}
    assert got == expected | on_it and len(got) > 300 and on_it - expected


def test_a_polygon_of_a_hundred_thousand_edges(spark):
    """A circle with a radius of 60 km: a point meets the edges of its own cell only."""
    n, radius, lat = 100_000, 60_000.0, 39.7
    kx = math.cos(math.radians(lat))
    place = lambda r, t: (
        f"-105 + {r} * cos({t}) / {geo.METERS_PER_DEGREE * kx!r}D",
        f"{lat} + {r} * sin({t}) / {geo.METERS_PER_DEGREE!r}D",
    )
    (x1, y1), (x2, y2) = place(radius, f"id * {2 * math.pi / n!r}D"), place(radius, f"((id + 1) % {n}) * {2 * math.pi / n!r}D")
    edges = spark.range(n).selectExpr(
        f"struct({x1} as lon1, {y1} as lat1, {x2} as lon2, {y2} as lat2) as e"
    )
    polygons = edges.agg(F.collect_list("e").alias("edges")).withColumn("geoid", F.lit("c"))
    x, y = place("r", "id * 0.7D")
    points = spark.range(3_000).selectExpr("id", "(id * 37) % 70000 as r").selectExpr("r", f"{x} as lon", f"{y} as lat")
    found = points_near_polygons(points, polygons, "geoid", 800.0).join(points, ["lon", "lat"]).collect()
    inner = [r.r for r in found if r.distance_m == 0]
    expected = [r for r in ((i * 37) % 70000 for i in range(3_000)) if r < radius]
    assert abs(len(inner) - len(expected)) <= 2 and max(inner) <= radius + 1
    assert all(r.r < radius + 810 for r in found)


def test_pairs_near_polygons_are_not_shuffled(spark):
    points = spark.range(300).selectExpr("-105 + id % 20 * 0.002D as lon", "39.7 + id div 20 * 0.002D as lat")
    corners = ("x, y", "x + 0.003D, y", "x, y + 0.003D")
    sides = (", ".join(f"'{n}', {v}" for n, v in zip(("lon1", "lat1", "lon2", "lat2"), f"{a}, {b}".split(", ")))
             for a, b in zip(corners, corners[1:] + corners[:1]))
    ring = f"array({', '.join(f'named_struct({side})' for side in sides)})"
    polygons = spark.range(60).selectExpr(
        "cast(id as string) as geoid", "id * 1.5D as w", "-105 + id % 8 * 0.005D as x", "39.7 + id div 8 * 0.005D as y"
    ).selectExpr("geoid", "w", f"{ring} as edges")
    columns = ("lon", "lat", "geoid", "distance_m")
    plain = rows(points_near_polygons(points, polygons, "geoid", 500.0), *columns)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        near = points_near_polygons(points, polygons, "geoid", 500.0, rows_per_split=40, carry=("w",))
        plan = near._jdf.queryExecution().executedPlan().toString()
        found = near.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    assert all(r.w == int(r.geoid) * 1.5 for r in found)
    assert ordered(tuple(r[c] for c in columns) for r in found) == plain and len(plain) > 300
