import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stopwise.plans import events, headways, reliability, schedule, staging
from tests.conftest import ordered, rows, utc

UPDATES = (
    "feed_ts_utc timestamp, entity_id string, trip_id string, route_id string, stop_id string, "
    "stop_sequence long, arrival_delay_sec long, departure_delay_sec long, "
    "schedule_relationship string, event_ts_utc timestamp"
)
POSITIONS = (
    "feed_ts_utc timestamp, entity_id string, trip_id string, route_id string, "
    "vehicle_id string, vehicle_label string, lon double, lat double, bearing double, "
    "speed_mps double, event_ts_utc timestamp"
)
EX = date(2025, 1, 14)
CALENDAR = (
    "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, "
    "saturday int, sunday int, start_date string, end_date string, _extract_date date"
)


def update(feed, trip="T1", route="R1", stop="S1", seq=1, arr=None, dep=None, at=None, entity="e"):
    return (utc(feed), entity, trip, route, stop, seq, arr, dep, "SCHEDULED", at and utc(at))


def position(feed, trip="T1", route="R1", vehicle="V", at=None, entity="v"):
    return (utc(feed), entity, trip, route, vehicle, None, -105.0, 39.7, None, 3.0, at and utc(at))


def test_merge_equals_full_join_with_row_number(spark):
    rng = random.Random(17)
    feeds = ["2025-01-14 10:00:00", "2025-01-14 10:05:00"]
    times = [None, "2025-01-14 10:01:00", "2025-01-14 10:02:00", "2025-01-14 10:03:00"]

    def pick(*options):
        return rng.choice(options)

    ups = [
        update(pick(*feeds), pick("T1", "T2", "T3", None), pick("R1", "R2", None),
               pick("S1", "S2", None), pick(1, 2, None), pick(None, 5, 9), pick(None, 3),
               pick(*times), pick("a", "b", None))
        for _ in range(120)
    ]
    poss = [
        position(pick(*feeds), pick("T1", "T2", "T4", None), pick("R1", "R2", None),
                 pick("V1", "V2", None), pick(*times), pick("x", "y", None))
        for _ in range(60)
    ]
    u, p = spark.createDataFrame(ups, UPDATES), spark.createDataFrame(poss, POSITIONS)
    brute = spark.sql(
        """
        select * from (
            select *, row_number() over (partition by feed_ts_utc, trip_id order by
                event_ts_utc desc, tu_entity_id desc, vp_entity_id desc, stop_sequence desc,
                stop_id desc, arrival_delay_sec desc, departure_delay_sec desc,
                schedule_relationship desc, vehicle_id desc, route_id desc) as rn
            from (
                select coalesce(u.feed_ts_utc, p.feed_ts_utc) as feed_ts_utc,
                       coalesce(u.trip_id, p.trip_id) as trip_id,
                       coalesce(u.route_id, p.route_id) as route_id,
                       u.entity_id as tu_entity_id, p.entity_id as vp_entity_id, stop_id,
                       stop_sequence, arrival_delay_sec, departure_delay_sec,
                       schedule_relationship, vehicle_id,
                       coalesce(u.event_ts_utc, p.event_ts_utc, u.feed_ts_utc, p.feed_ts_utc)
                           as event_ts_utc
                from {u} u full outer join {p} p on u.feed_ts_utc = p.feed_ts_utc
                     and u.trip_id = p.trip_id and u.route_id = p.route_id)) where rn = 1""",
        u=u, p=p,
    ).drop("rn")
    found = events.merge_feeds(u, p).select(*brute.columns)
    assert found.count() == brute.count() == 10
    assert rows(found) == rows(brute)


def _dims(spark, params):
    calendar = spark.createDataFrame(
        [
            ("week", 1, 1, 1, 1, 1, 0, 0, "20250101", "20250131", EX),
            ("never", 0, 0, 0, 0, 0, 0, 0, "20250101", "20250131", EX),
            ("reversed", 1, 1, 1, 1, 1, 1, 1, "20250131", "20250101", EX),
            ("blank", 1, 1, 1, 1, 1, 1, 1, "", "20250131", EX),
            ("old", 1, 1, 1, 1, 1, 1, 1, "20250101", "20250131", date(2025, 1, 1)),
        ],
        CALENDAR,
    )
    exceptions = spark.createDataFrame(
        [
            ("never", "20250111", 1, EX), ("week", "20250113", 2, EX),
            ("unknown", "20250112", 1, EX), ("week", "bad", 1, EX), ("week", "20290101", 1, EX),
        ],
        "service_id string, date string, exception_type int, _extract_date date",
    )
    raw_trips = spark.createDataFrame(
        [("R1", "week", "T1", "North", 0, "H", EX), ("R1", "never", "T2", "South", None, "H", EX)],
        "route_id string, service_id string, trip_id string, trip_headsign string, "
        "direction_id long, shape_id string, _extract_date date",
    )
    raw_times = spark.createDataFrame(
        [
            ("T1", "10:00:00", "10:01:00", "S1", 1, EX), ("T1", "", None, "S2", 2, EX),
            ("T1", "25:10:00", "25:10:00", "S3", 3, EX), ("T2", "08:00:00", None, "S1", 1, EX),
            ("T1", "11:00:00", None, "S1", 1, EX), ("T1", "10:00:00", None, "S1", 1, date(2025, 1, 1)),
        ],
        "trip_id string, arrival_time string, departure_time string, stop_id string, "
        "stop_sequence long, _extract_date date",
    )
    trips = staging.trips(raw_trips, calendar, exceptions)
    running = schedule.service_dates(calendar, exceptions, date(2025, 1, 10), date(2025, 1, 15))
    return trips, running, schedule.trip_patterns(trips, running, staging.stop_times(raw_times))


def test_schedule(spark, params):
    trips, running, patterns = _dims(spark, params)
    assert rows(running.select("service_id", F.day("service_date"))) == ordered(
        [("week", 10), ("week", 14), ("week", 15), ("never", 11), ("unknown", 12)]
    )
    arrivals = schedule.scheduled_arrivals(patterns, params).where("service_date_mst = '2025-01-14'")
    assert rows(
        arrivals, "stop_id", F.col("sched_arrival_ts_mst").cast("string"),
        F.col("sched_departure_ts_mst").cast("string"),
    ) == [
        ("S1", "2025-01-14 17:00:00", "2025-01-14 17:01:00"),
        ("S3", "2025-01-15 08:10:00", "2025-01-15 08:10:00"),
    ]
    arrays = {r.trip_id: r for r in trips.collect()}
    assert arrays["T1"].removed_service_dates == ["20250113"]
    assert arrays["T2"].added_service_dates == ["20250111"]
    assert arrays["T2"].removed_service_dates is None


def test_events_take_delays_from_the_schedule(spark, params):
    trips, _, patterns = _dims(spark, params)
    ups = [
        update("2025-01-14 17:00:00", at="2025-01-14 17:04:10"),  # scheduled
        update("2025-01-14 17:05:00", arr=30, at="2025-01-14 17:04:10"),  # reported
        update("2025-01-14 17:10:00", stop="S9", at="2025-01-14 17:10:00"),  # no schedule
        update("2025-01-13 17:00:00", at="2025-01-13 17:04:10"),  # removed date
        update("2025-01-15 08:00:00", stop="S3", seq=3, at="2025-01-15 08:12:00"),  # after midnight
        update("2024-11-01 08:00:00", arr=1, at="2024-11-01 08:00:00"),  # too old
    ]
    poss = [position("2025-01-14 18:00:00")]
    found = events.rt_events(
        spark.createDataFrame(ups, UPDATES), spark.createDataFrame(poss, POSITIONS), trips,
        patterns, params,
    )
    by_feed = {r.feed_ts_utc.strftime("%d %H:%M"): r for r in found.collect()}
    assert len(by_feed) == 6
    assert (by_feed["14 17:00"].arrival_delay_sec, by_feed["14 17:00"].departure_delay_sec) == (250, 190)
    assert by_feed["14 17:05"].arrival_delay_sec == 30
    assert by_feed["14 17:10"].arrival_delay_sec is None
    assert by_feed["13 17:00"].arrival_delay_sec is None
    # The service day is the local date of the event: 25:10 pairs with the next day's trip.
    assert by_feed["15 08:00"].arrival_delay_sec == 120 - 86_400
    assert by_feed["14 18:00"].stop_id is None
    assert by_feed["14 18:00"].trip_headsign == "North"

    resolved = {r.event_ts_utc.strftime("%d %H:%M:%S"): r for r in events.resolve(found, params).collect()}
    silent = resolved["14 17:10:00"]
    assert (silent.delay_sec, silent.delay_sec_raw, silent.is_on_time) == (0, None, 1)


def test_on_time_edges(spark, params):
    df = spark.createDataFrame(
        [(d,) for d in (-301, -300, 300, 301)], "arrival_delay_sec long"
    ).select(
        *[F.lit(None).cast("string").alias(c) for c in ("route_id", "trip_id", "stop_id", "direction_id")],
        F.lit(EX).alias("event_date_mst"), F.lit(1).alias("event_hour_mst"),
        F.lit(None).cast("timestamp").alias("event_ts_utc"), "arrival_delay_sec",
        F.lit(None).cast("long").alias("departure_delay_sec"),
    )
    found = events.resolve(df, params)
    assert rows(found, "delay_sec", "is_on_time") == ordered([(-301, 0), (-300, 1), (300, 1), (301, 0)])


def _observed(spark, times, route="R1", direction=0):
    day = date(2025, 1, 14)
    return spark.createDataFrame(
        [(route, direction, "S1", day, utc(t)) for t in times],
        "route_id string, direction_id long, stop_id string, service_date_mst date, event_ts_utc timestamp",
    )


def test_headways_drop_copies(spark, params):
    times = ["2025-01-14 17:00:00", "2025-01-14 17:10:00", "2025-01-14 17:10:00", "2025-01-14 17:15:00"]
    found = headways.headways_observed(_observed(spark, times), params)
    assert [r.obs_headway_sec for r in found.orderBy("event_ts_utc").collect()] == [None, 600, 300]


@pytest.mark.parametrize(
    ("offset", "obs", "sch", "expected"),
    [
        (1800, 600, 600, 1), (1801, 600, 600, 0), (0, 900, 600, 1), (0, 901, 600, 0),
        (0, 300, 600, 1), (0, 299, 600, 0), (-1800, 600, 600, 1), (0, 600, 0, 0),
    ],
)
def test_adherence_edges(spark, params, offset, obs, sch, expected):
    at = utc("2025-01-14 17:00:00")
    observed = _observed(spark, ["2025-01-14 17:00:00"], direction=None).withColumn(
        "obs_headway_sec", F.lit(obs).cast("long")
    )
    planned = observed.select(
        *headways.KEYS,
        F.lit(at + timedelta(seconds=offset)).alias("sched_arrival_ts_mst"),
        F.lit(sch).cast("long").alias("sch_headway_sec"),
    )
    found = headways.headway_adherence(observed, planned, params)
    assert [r.headway_adherent for r in found.collect()] == [expected]
    assert headways.headway_adherence(observed, planned.limit(0), params).count() == 0


def _resolved(spark, tuples):
    return spark.createDataFrame(
        tuples,
        "route_id string, stop_id string, service_date_mst date, event_hour_mst int, delay_sec long, "
        "delay_sec_raw long",
    ).withColumn("event_ts_utc", F.lit(utc("2025-01-14 17:00:00")))


def test_route_day_and_weather(spark, params):
    d1, d2 = date(2025, 1, 14), date(2025, 1, 13)
    resolved = _resolved(
        spark,
        [("R1", "S1", d1, 10, 300, 300), ("R1", "S1", d1, 10, 301, 301), ("R1", None, d1, 10, 0, None),
         ("R1", "S1", d2, 10, 10, 10)],
    )
    weather = spark.createDataFrame(
        [
            (d1, "A", 1.0, None, "light"), (d1, "B", None, 1, "heavy"), (d1, "C", 9.0, 0, None),
            (date(2025, 1, 12), "A", None, None, None),
        ],
        "date date, station string, precip_mm double, snow_day long, precip_bin string",
    )
    days = reliability.weather_by_date(weather, params)
    assert rows(days, "snow_day", "precip_bin") == ordered([(True, "light"), (False, None)])
    one = reliability.weather_by_date(weather, replace(params, weather_station="B"))
    assert rows(one, "snow_day", "precip_bin") == [(True, "heavy")]

    found = reliability.reliability_by_route_day(resolved, days, params, exact=True)
    assert rows(
        found, F.day("service_date_mst"), "precip_bin", "snow_day", "n_events", "n_reported_events",
        F.round("pct_on_time", 4), "median_delay_sec", "p90_delay_sec",
    ) == ordered([(14, "light", True, 3, 2, 0.6667, 300, 301), (13, "none", False, 1, 1, 1.0, 10, 10)])

    impacts = reliability.weather_impacts(found, params)
    assert rows(impacts, "precip_bin", F.round("delta_pct_on_time", 4)) == ordered(
        [("light", -0.3333), ("none", 0.0)]
    )


def test_approximate_and_exact_quantiles_agree_on_small_groups(spark, params):
    d = date(2025, 1, 14)
    resolved = _resolved(spark, [("R1", "S1", d, 10, i * 7 % 101, 1) for i in range(101)])
    days = spark.createDataFrame([], "service_date_mst date, snow_day boolean, precip_bin string")
    both = [
        rows(reliability.reliability_by_route_day(resolved, days, params, exact=e),
             "median_delay_sec", "p90_delay_sec")
        for e in (True, False)
    ]
    assert both[0] == both[1] == [(50, 90)]


def test_stop_hour_mode_ties_to_the_smallest_route(spark, params):
    d = date(2025, 1, 14)
    resolved = _resolved(
        spark,
        [("R2", "S1", d, 10, 0, 0), ("R1", "S1", d, 10, 0, 0), (None, "S1", d, 10, 0, 0),
         (None, "S1", d, 10, 0, 0), (None, "S1", d, 10, 0, 0), (None, "S2", d, 10, 0, 0),
         ("R1", None, d, 10, 0, 0)],
    )
    adherence = spark.createDataFrame([], headways.ADHERENCE_DDL)
    found = reliability.reliability_by_stop_hour(resolved, adherence, params)
    assert rows(found, "stop_id", "n_events", "route_id_mode", "headway_adherence_rate") == [
        ("S1", 5, "R1", None), ("S2", 1, "unknown", None),
    ]


def test_scheduled_headways_hold_no_expanded_rows(spark):
    day = date(2025, 1, 14)
    at = [utc("2025-01-14 17:00:00") + timedelta(seconds=s) for s in (0, 0, 60, 60, 60, 200)]
    planned = spark.createDataFrame(
        [("R1", d, "S1", day, t) for d in (1, None) for t in at] + [("R1", 1, "S1", day, None)],
        "route_id string, direction_id long, stop_id string, service_date_mst date, sched_arrival_ts_mst timestamp",
    )
    found = headways.headways_scheduled(planned)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1
    gaps = [(t, g) for t, g in ((at[0], None), (at[2], 60), (at[5], 140))]
    shown = found.select("direction_id", F.unix_seconds("sched_arrival_ts_mst"), "sch_headway_sec")
    assert rows(shown) == ordered((d, int(t.timestamp()), g) for d in (1, None) for t, g in gaps)


def test_tasks_grow_in_number_before_size(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "2m"
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 400
