"""Streaming queries over the given event table, read as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.driver.catalog import register
from stopwise.driver.model import Model
from stopwise.driver.transit import EVENT_COLUMNS
from stopwise.driver.views import FANOUT, SCHEMAS, VIEWS
from stopwise.plans import events
from stopwise.session import shared_dir
from stopwise.sinks.tables import materialize
from stopwise.streaming import joined, realtime


ARRIVALS = 3


def _event_stream(m: Model) -> DataFrame:
    """The event table as a file stream, whether it is one file or a folder of parts.

    A stream needs a folder or a pattern; the bracket makes the table's own path a pattern.
    """
    table = f"{m.inputs.sf_dir}/events.parque[t]"
    return m.inputs.spark.readStream.schema(SCHEMAS["events"]).parquet(table)


def _split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both feeds out of a micro-batch of the event table, in the columns of the raw feeds."""

    def feed(view: str, dataset) -> DataFrame:
        rows = batch.sparkSession.sql(VIEWS[view].replace("{fanout}", FANOUT["spark"]), events=batch)
        return rows.select(
            *[
                F.col(f.name).cast(f.dataType) if f.name in rows.columns
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in dataset.schema
            ]
        )

    return feed("v_updates", realtime.UPDATES), feed("v_positions", realtime.POSITIONS)


def _run(m: Model, marts: bool, weather_days: DataFrame | None = None) -> realtime.Store:
    store = realtime.Store(shared_dir(m.inputs.spark, "realtime"))
    weather_days = m.weather_days if weather_days is None else weather_days
    dims = realtime.Dimensions(m.trips, m.patterns, m.scheduled_headways, weather_days)
    dims = realtime.materialized(dims, marts)
    spark, feed = m.inputs.spark, shared_dir(m.inputs.spark, "feed")
    # Three deliveries of whole hours, not in order of time: later ones bring late snapshots. The
    # two feeds of an hour come in different ones, so events are resolved again and may move.
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3_600)
    second = F.col("event_type").isin("signup", "purchase").cast("int")
    arrivals = m.inputs.events.withColumn("_arrival", F.pmod(hour + second, F.lit(ARRIVALS)))
    for n in range(ARRIVALS):
        arrivals.where(F.col("_arrival") == n).drop("_arrival").write.mode("append").parquet(feed)
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(feed)
        realtime.run_stream(stream, store, dims, m.params, _split, marts).awaitTermination()
    return store


@register(
    "rt_stream_upsert",
    EVENT_COLUMNS + " direction_id:i trip_headsign:s event_date_mst:d event_hour_mst:i",
    "SELECT * FROM b_events",
)
def _rt_stream_upsert(m: Model):
    return _run(m, marts=False).read(m.inputs.spark, "events")


@register(
    "rt_stream_route_day",
    "route_id:s service_date_mst:d precip_bin:s snow_day:b n_events:i n_reported_events:i "
    "pct_on_time:f mean_delay_sec:f",
    "SELECT * FROM b_route_day",
)
def _rt_stream_route_day(m: Model):
    return _run(m, marts=True).read(m.inputs.spark, "route_day")


@register(
    "rt_late_weather",
    "route_id:s service_date_mst:d precip_bin:s snow_day:b n_events:i n_reported_events:i "
    "pct_on_time:f mean_delay_sec:f",
    "SELECT * FROM b_route_day",
)
def _rt_late_weather(m: Model):
    """The stream runs on a first weather load, then the newest one arrives.

    In the first load a third of the days of the lookback are absent and another third differ.
    """
    day, kind = "service_date_mst", F.dayofmonth("service_date_mst") % 3
    late = F.col(day) >= F.lit(m.params.days_ago(m.params.weather_lookback_days))
    weather_days = materialize(m.weather_days, "weather")  # read by the first load and the refresh
    first = weather_days.where(~(late & (kind == 0))).select(
        day,
        F.when(late & (kind == 1), ~F.col("snow_day")).otherwise(F.col("snow_day")).alias("snow_day"),
        F.when(late & (kind == 1), "heavy").otherwise(F.col("precip_bin")).alias("precip_bin"),
    )
    store = _run(m, True, first)
    dims = realtime.Dimensions(m.trips, m.patterns, m.scheduled_headways, weather_days)
    realtime.refresh_weather(store, m.inputs.spark, dims, m.params)
    return store.read(m.inputs.spark, "route_day")


@register(
    "stop_hour_stream",
    "window_start:t stop_id:s n_events:i pct_on_time:f mean_delay_sec:f",
    """SELECT date_trunc('hour', event_ts_utc) AS window_start, stop_id, count(*) AS n_events,
              avg(CASE WHEN abs(delay) <= 300 THEN 1 ELSE 0 END) AS pct_on_time,
              avg(delay) AS mean_delay_sec
       FROM (SELECT *, coalesce(arrival_delay_sec, departure_delay_sec, 0) AS delay
             FROM v_updates) AS u
       WHERE event_ts_utc IS NOT NULL GROUP BY ALL""",
)
def _stop_hour_stream(m: Model):
    root = shared_dir(m.inputs.spark, "live")
    stream = m.inputs.spark.sql(VIEWS["v_updates"], events=_event_stream(m))
    dated = stream.withColumns(
        {"event_date_mst": F.lit(None).cast("date"), "event_hour_mst": F.lit(None).cast("int"),
         "direction_id": F.lit(None).cast("long")}
    )
    view = realtime.stop_hour_live(events.resolve(dated, m.params), m.params)
    view = view.withColumn("window_day", F.to_date("window_start"))
    realtime.write_live(
        view, f"{root}/stop_hour", f"{root}/_checkpoint", ["window_start", "stop_id"],
        "window_day",
    ).awaitTermination()
    return m.inputs.spark.read.parquet(f"{root}/stop_hour")


def _in_order(m: Model, label: str, build) -> DataFrame:
    """What a stream appends over the events in three deliveries by time, positions six hours late."""
    spark, root = m.inputs.spark, shared_dir(m.inputs.spark, label)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_type").isin("signup", "purchase"), 6 * 3_600).otherwise(0)
    first, last = m.inputs.events.agg(F.min(second), F.max(second)).first()
    third = ((last or 0) - (first or 0)) // ARRIVALS + 1
    part = F.least(F.floor((second + late - (first or 0)) / third), F.lit(ARRIVALS - 1))
    arrivals = m.inputs.events.withColumn("_arrival", part)
    for n in range(ARRIVALS):
        arrivals.where(F.col("_arrival") == n).drop("_arrival").write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(SCHEMAS["events"]).parquet(f"{root}/feed")
        found = build(stream)
        joined.append_to(found, f"{root}/table", f"{root}/_checkpoint").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/table")


@register(
    "rt_stream_join",
    EVENT_COLUMNS,
    """SELECT * FROM b_merged
       WHERE feed_ts_utc <= least((SELECT max(feed_ts_utc) FROM v_updates),
                                  (SELECT max(feed_ts_utc) FROM v_positions)) - INTERVAL 12 HOUR""",
)
def _rt_stream_join(m: Model):
    def build(stream: DataFrame) -> DataFrame:
        updates, positions = (
            events.recent(stream.sparkSession.sql(VIEWS[v], events=stream), m.params)
            for v in ("v_updates", "v_positions")
        )
        return joined.merge_streams(updates, positions)

    return _in_order(m, "joined", build)


@register(
    "feed_gaps_stream",
    "missing_from:t",
    """WITH w AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, event_ts_utc) AS s FROM v_updates
                  WHERE event_ts_utc IS NOT NULL),
            final AS (SELECT s FROM w WHERE s + INTERVAL 5 MINUTE <=
                      (SELECT max(event_ts_utc) FROM v_updates) - INTERVAL 12 HOUR)
       SELECT g AS missing_from
       FROM (SELECT unnest(generate_series((SELECT min(s) FROM final), (SELECT max(s) FROM final),
                                           INTERVAL 5 MINUTE)) AS g) AS grid
       WHERE g NOT IN (SELECT s FROM final)""",
)
def _feed_gaps_stream(m: Model):
    def build(stream: DataFrame) -> DataFrame:
        updates = stream.sparkSession.sql(VIEWS["v_updates"], events=stream)
        return joined.gaps(updates.select(F.col("event_ts_utc").alias("feed_ts_utc")))

    return _in_order(m, "gaps", build)
