import random
from datetime import timedelta

from pyspark.sql import functions as F

from stopwise.plans import events
from stopwise.streaming import joined, realtime
from tests.conftest import rows, utc

START = utc("2025-01-10 00:00")


def _feeds(spark, hours, seed=3):
    """Random rows of both feeds per hour: trips with several routes, null trips and routes, repeats."""
    rng = random.Random(seed)
    updates, positions = [], []
    for n in range(hours):
        at = START + timedelta(hours=n)
        for i in range(rng.randrange(2, 9)):
            trip, route = rng.choice(["A", "B", None]), rng.choice(["R1", "R2", None])
            seen = rng.choice([None, at + timedelta(seconds=rng.randrange(3))])
            updates.append((at, f"e{rng.randrange(3)}", trip, route, "S1", i % 2, i, i, "SCHEDULED", seen))
            trip, route = rng.choice(["A", "C", None]), rng.choice(["R1", "R2", None])
            seen = rng.choice([None, at + timedelta(seconds=rng.randrange(3))])
            positions.append((at, f"v{rng.randrange(3)}", trip, route, "B1", "Bus", 1.0 * i, 2.0, 3.0, 4.0, seen))
    u = spark.createDataFrame(
        updates,
        "feed_ts_utc timestamp, entity_id string, trip_id string, route_id string, stop_id string, "
        "stop_sequence int, arrival_delay_sec int, departure_delay_sec int, "
        "schedule_relationship string, event_ts_utc timestamp",
    )
    p = spark.createDataFrame(
        positions,
        "feed_ts_utc timestamp, entity_id string, trip_id string, route_id string, vehicle_id string, "
        "vehicle_label string, lon double, lat double, bearing double, speed_mps double, "
        "event_ts_utc timestamp",
    )
    return u, p


def _between(df, first, last):
    return df.where(F.col("feed_ts_utc").between(START + timedelta(hours=first), START + timedelta(hours=last - 1)))


def _stream(spark, like, path):
    return spark.readStream.schema(like.schema).parquet(path)


def test_joined_streams_equal_the_batch_merge_and_forget(spark, folder):
    u, p = _feeds(spark, 24)
    kept = []
    for n in range(4):
        # Positions come two hours after the updates, within the delay of four.
        _between(u, 6 * n, 6 * n + 6).write.mode("append").parquet(f"{folder}/u")
        _between(p, 6 * n - 2 if n else 0, 6 * n + 4 if n < 3 else 24).write.mode("append").parquet(f"{folder}/p")
        found = joined.merge_streams(
            _stream(spark, u, f"{folder}/u"), _stream(spark, p, f"{folder}/p"), "4 hours"
        )
        query = joined.append_to(found, f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination()
        kept.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))
    written = spark.read.schema(found.schema).parquet(f"{folder}/out")
    expected = events.merge_feeds(_between(u, 0, 20), _between(p, 0, 20)).select(*found.columns)
    assert rows(written) == rows(expected)
    # State is that of the last hours, not of all that came.
    assert max(kept[1:]) < 3 * kept[0]


def test_rows_after_the_delay_are_not_taken_twice(spark, folder):
    u, p = _feeds(spark, 12)
    for part in (_between(u, 0, 12), _between(u, 0, 2)):
        part.write.mode("append").parquet(f"{folder}/u")
        p.write.mode("append").parquet(f"{folder}/p")
        found = joined.merge_streams(
            _stream(spark, u, f"{folder}/u"), _stream(spark, p, f"{folder}/p"), "1 hour"
        )
        joined.append_to(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    written = spark.read.schema(found.schema).parquet(f"{folder}/out")
    assert written.count() == written.select("feed_ts_utc", "trip_id").distinct().count()


def test_gaps_of_a_feed_across_deliveries(spark, folder):
    minutes = [0, 1, 7, 20, 21, 58, 59, 125, 400]
    at = [(START + timedelta(minutes=m),) for m in minutes]
    found = []
    for part in (at[:3], at[3:6], at[6:]):
        spark.createDataFrame(part, "feed_ts_utc timestamp").write.mode("append").parquet(f"{folder}/u")
        stream = spark.readStream.schema("feed_ts_utc timestamp").parquet(f"{folder}/u")
        query = joined.append_to(joined.gaps(stream, 5, "30 minutes"), f"{folder}/out", f"{folder}/checkpoint")
        query.awaitTermination()
        found.append(spark.read.schema("missing_from timestamp").parquet(f"{folder}/out").count())
    # Final windows start at 0, 5, 20, 55 and 125; the one of the last row is not final yet.
    expected = [m for m in range(0, 125, 5) if m not in (0, 5, 20, 55)]
    written = spark.read.schema("missing_from timestamp").parquet(f"{folder}/out")
    minute = F.expr(f"timestampdiff(minute, timestamp '{START.isoformat()}', missing_from)")
    assert sorted(r[0] for r in written.select(minute).collect()) == expected
    assert found[0] == 0 and found[1] == 2


def test_feeds_without_rows(spark, folder):
    u, p = _feeds(spark, 1)
    u.limit(0).write.parquet(f"{folder}/u")
    p.limit(0).write.parquet(f"{folder}/p")
    found = joined.merge_streams(_stream(spark, u, f"{folder}/u"), _stream(spark, p, f"{folder}/p"))
    joined.append_to(found, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    assert spark.read.schema(found.schema).parquet(f"{folder}/out").count() == 0
    assert realtime.WATERMARK == joined.DELAY


def test_a_key_is_kept_once_for_both_feeds(spark, folder):
    u, p = _feeds(spark, 24)
    u.write.parquet(f"{folder}/u")
    p.write.parquet(f"{folder}/p")
    found = joined.merge_streams(_stream(spark, u, f"{folder}/u"), _stream(spark, p, f"{folder}/p"), "4 hours")
    query = joined.append_to(found, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    both = u.select(*events.KEYS).unionByName(p.select(*events.KEYS))
    unmatched = F.col("trip_id").isNull() | F.col("route_id").isNull()
    keys = both.distinct().count() + both.where(unmatched).distinct().count()
    trips = both.select("feed_ts_utc", "trip_id").distinct().count()
    held = sum(s["numRowsUpdated"] for x in query.recentProgress for s in x["stateOperators"])
    assert 0 < held <= keys + trips
    assert not [s for x in query.recentProgress for s in x["stateOperators"] if "Join" in s["operatorName"]]
