"""Realtime feed as Structured Streaming: snapshots to events to reliability marts.

Every micro-batch adds its rows to the raw tables and records their files in the ledger, resolves the
snapshots it touched from all rows known of them, and recomputes the service dates whose events
changed. Each step overwrites what an earlier attempt of the same batch wrote, so a repeated batch
changes nothing, and rows and ledger always tell of the same files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from stopwise.functions.clock import local_date, utc_date
from stopwise.params import Params
from stopwise.plans import events, headways, reliability
from stopwise.session import scratch
from stopwise.sinks import tables
from stopwise.sources.raw import read_files, with_provenance
from stopwise.sources.schemas import DATASETS, MANIFEST, PROVENANCE, Dataset

UPDATES = DATASETS["raw_gtfsrt_trip_updates"]
POSITIONS = DATASETS["raw_gtfsrt_vehicle_positions"]
WATERMARK = "12 hours"


@dataclass(frozen=True)
class Feed:
    """Rows of one feed in a micro-batch, and the files (path, hash) that ``_file`` numbers."""

    rows: DataFrame
    files: list[tuple[str, str | None]]


#: Both feeds of a micro-batch; plain rows count as one file.
Split = Callable[[DataFrame], tuple[Feed | DataFrame, Feed | DataFrame]]


@dataclass(frozen=True)
class Store:
    """Folders of the tables below one root."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        return tables.read_table(spark, self.path(table))


@dataclass(frozen=True)
class Dimensions:
    """What the events are joined with; small or already materialized."""

    trips: DataFrame
    patterns: DataFrame
    scheduled_headways: DataFrame
    weather_days: DataFrame


def materialized(dims: Dimensions, marts: bool = True) -> Dimensions:
    """Dimensions that are written once instead of planned and run again by every step of every batch.

    Without marts only the trips and patterns are read, so the others stay as they are.
    """
    names = [f.name for f in fields(Dimensions)]
    kept = names if marts else ["trips", "patterns"]
    return replace(dims, **{n: tables.materialize(getattr(dims, n), f"dim-{n}") for n in kept})


# -- sources ----------------------------------------------------------------------------


def snapshot_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Paths of new feed files, each file exactly once; ``max_files`` bounds a micro-batch."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv.gz")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(f"{root.rstrip('/')}/{UPDATES.folder}").select("path")


def snapshot_manifests(
    spark: SparkSession, root: str, max_drops: int | None = None
) -> DataFrame:
    """Path and text of new manifests, each exactly once; ``max_drops`` bounds a micro-batch.

    A manifest is written last, so the files that it names are complete. A drop without one waits.
    """
    reader = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{manifest.json,part-*.txt}")
    )
    if max_drops:
        reader = reader.option("maxFilesPerTrigger", max_drops)
    found = reader.load(f"{root.rstrip('/')}/{UPDATES.folder}")
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    return found.select(path.alias("path"), "value").where(F.contains("path", F.lit("/manifest.json")))


def _feeds(spark: SparkSession, files: list[tuple[str, str | None]]) -> tuple[Feed, Feed]:
    """Rows of both feeds, read as the batch load reads them: declared options, strict."""
    now = datetime.now(UTC)

    def feed(dataset: Dataset) -> Feed:
        own = [f for f in files if f"/{dataset.file}" in f[0]]
        if not own:
            schema = f"{dataset.ddl}, {PROVENANCE}, _file int"
            return Feed(spark.createDataFrame([], schema), [])
        numbered = [(path, md5, i) for i, (path, md5) in enumerate(own)]
        hashes = spark.createDataFrame(numbered, "source_path string, hash_md5 string, _file int")
        rows = read_files(spark, dataset, [path for path, _ in own], strict=True)
        return Feed(with_provenance(rows, hashes, now), own)

    return feed(UPDATES), feed(POSITIONS)


def read_manifests(batch: DataFrame) -> tuple[Feed, Feed]:
    """The feeds of the files that a micro-batch of manifests names, with the manifests' hashes.

    A manifest that is not JSON is an error: the stream must not pass over its files. The paths go
    to the reader, which keeps them on the driver in any case.
    """
    named = batch.select(
        F.regexp_replace("path", "/manifest\\.json(/[^/]*)?$", "").alias("drop"),
        F.explode(F.from_json("value", MANIFEST, {"mode": "FAILFAST"})["files"]).alias("name", "entry"),
    )
    files = named.select(F.concat_ws("/", "drop", "name").alias("path"), "entry.hash_md5").distinct()
    return _feeds(batch.sparkSession, sorted(map(tuple, files.collect())))


def read_snapshots(files: DataFrame) -> tuple[Feed, Feed]:
    """The feeds of a micro-batch of paths; hashes are those of the bytes.

    The paths go back to the reader, which keeps them on the driver in any case.
    """
    spark = files.sparkSession
    paths = sorted(r.path for r in files.select("path").distinct().collect())
    if not paths:
        return _feeds(spark, [])
    read = spark.read.format("binaryFile").load(paths).select("path", F.md5("content"))
    return _feeds(spark, sorted(map(tuple, read.collect())))


# -- micro-batch ------------------------------------------------------------------------


def add_raw(store: Store, name: str, feed: Feed | DataFrame, batch_id: int) -> DataFrame:
    """Add rows to a raw table under their batch and UTC day; returns the batch's snapshots.

    The ledger entry of the batch (path, hash and rows of every file) is written after the rows, which
    counted themselves.
    """
    if isinstance(feed, DataFrame):
        feed = Feed(feed.withColumn("_file", F.lit(0)), [(f"batch {batch_id}", None)])
    rows, spark = feed.rows, feed.rows.sparkSession
    path = store.path(name)
    stamped = rows.withColumn("feed_date", utc_date("feed_ts_utc"))
    counts = tables.write_load(
        stamped, path, "batch", batch_id, "feed_date", ("route_id", "trip_id"), len(feed.files)
    )
    now = datetime.now(UTC)
    entries = spark.createDataFrame(
        [(file, md5, now, n) for (file, md5), n in zip(feed.files, counts, strict=True)],
        "_source_path string, _hash_md5 string, _loaded_at timestamp, rows long",
    )
    tables.commit_load(entries, store.path("ledger"), name, "batch", batch_id)
    written = tables.read_table(spark, path)
    if written is None:
        return rows.limit(0).select("feed_ts_utc")
    return written.where(F.col("batch") == batch_id).select("feed_ts_utc").distinct()


def _dates(df: DataFrame, column: str) -> list[date]:
    """Distinct dates; a batch spans few."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0])


def resolve_snapshots(
    store: Store, snapshots: DataFrame, batch_id: int, dims: Dimensions, params: Params
) -> list[date]:
    """Resolve the given snapshots again from the raw tables and upsert their events.

    Returns the service dates whose events may have changed: those of the events now, and those
    of the same snapshots without this batch, where the table still has them. Only these
    partitions are read and rewritten.
    """
    spark = snapshots.sparkSession
    snapshots = tables.materialize(snapshots.distinct(), "snapshots")
    days = _dates(snapshots.select(utc_date("feed_ts_utc").alias("day")), "day")
    if not days:
        return []

    def known(name: str, dataset: Dataset) -> DataFrame:
        raw = store.read(spark, name)
        if raw is None:
            raw = spark.createDataFrame([], f"{dataset.ddl}, feed_date date, batch int")
        recent = raw.where(F.col("feed_date").isin(days))
        return recent.join(snapshots, "feed_ts_utc", "left_semi")

    updates, positions = known("raw_updates", UPDATES), known("raw_positions", POSITIONS)
    found = events.rt_events(updates, positions, dims.trips, dims.patterns, params)
    found = tables.materialize(found, "batch-events")
    before = events.merge_feeds(
        *[events.recent(f.where(F.col("batch") != batch_id), params) for f in (updates, positions)]
    ).select(local_date("event_ts_utc", params.zone).alias("day"))
    changed = sorted({*_dates(found, "event_date_mst"), *_dates(before, "day")})
    if changed:
        tables.upsert(
            found,
            store.path("events"),
            ["feed_ts_utc", "trip_id"],
            "event_date_mst",
            lookback=_among("event_date_mst", changed),
            cluster=("route_id", "trip_id"),
        )
    return changed


def _among(column: str, dates: list[date]) -> str:
    return f"{column} in ({', '.join(f"date '{d}'" for d in dates)})"


def recompute_dates(
    store: Store, spark: SparkSession, dates: list[date], dims: Dimensions, params: Params
) -> None:
    """Rebuild adherence and the reliability marts of whole service dates."""
    if not dates:
        return
    day = "service_date_mst"
    found = store.read(spark, "events").where(_among("event_date_mst", dates))
    resolved = events.resolve(found, params)
    observed = headways.headways_observed(resolved, params, dates[0])
    planned = dims.scheduled_headways.where(_among(day, dates))
    adherence = headways.headway_adherence(observed, planned, params, dates[0])
    adherence = tables.materialize(adherence, "batch-adherence")
    stop_hour = reliability.reliability_by_stop_hour(resolved, adherence, params)
    route_day = reliability.reliability_by_route_day(resolved, dims.weather_days, params)
    marts = (
        ("adherence", adherence, adherence, ("route_id", "stop_id")),
        ("stop_hour", stop_hour, resolved.where("stop_id is not null"), ("stop_id",)),
        ("route_day", route_day, resolved, ("route_id",)),
    )
    for name, mart, source, cluster in marts:
        tables.overwrite_partitions(mart, store.path(name), day, cluster)
        # A recomputed date that has no rows any more loses its old ones.
        gone = set(dates) - set(_dates(source, day))
        tables.drop_partitions(spark, store.path(name), day, sorted(gone))
    impacts = reliability.weather_impacts(store.read(spark, "route_day"), params)
    tables.overwrite(impacts, store.path("impacts"))


def stale_weather(
    route_day: DataFrame, weather_days: DataFrame, since: date | None = None
) -> list[date]:
    """Dates of a mart whose rows were built with other weather than there is now.

    The mart carries the weather of each date, so it is compared with the newest records by itself:
    two columns of the lookback are read, and a refresh that died goes on where it stopped.
    """
    day = "service_date_mst"
    built = route_day if since is None else route_day.where(F.col(day) >= F.lit(since))
    now = weather_days.select(
        day, F.col("precip_bin").alias("_bin"), F.col("snow_day").alias("_snow")
    )
    compared = built.select(day, "precip_bin", "snow_day").distinct().join(now, day, "left")
    same = F.col("precip_bin").eqNullSafe(F.coalesce("_bin", F.lit("none"))) & F.col(
        "snow_day"
    ).eqNullSafe(F.coalesce("_snow", F.lit(False)))
    return _dates(compared.where(~same), day)


def refresh_weather(
    store: Store, spark: SparkSession, dims: Dimensions, params: Params = Params()
) -> list[date]:
    """Rebuild the route days of the lookback whose weather changed; returns their dates.

    Other dates are neither read nor written.
    """
    built = store.read(spark, "route_day")
    if built is None:
        return []
    since = params.days_ago(params.weather_lookback_days)
    changed = stale_weather(built, dims.weather_days, since)
    if changed:
        found = store.read(spark, "events").where(_among("event_date_mst", changed))
        route_day = reliability.reliability_by_route_day(
            events.resolve(found, params), dims.weather_days, params
        )
        tables.overwrite_partitions(
            route_day, store.path("route_day"), "service_date_mst", ("route_id",)
        )
        impacts = reliability.weather_impacts(store.read(spark, "route_day"), params)
        tables.overwrite(impacts, store.path("impacts"))
    return changed


def process_batch(
    batch: DataFrame,
    batch_id: int,
    store: Store,
    dims: Dimensions,
    params: Params = Params(),
    split: Split = read_snapshots,
    marts: bool = True,
) -> None:
    """One micro-batch from raw rows to marts; both feeds of a snapshot meet in the raw tables.

    What it wrote on the way is dropped at its end.
    """
    with scratch(batch.sparkSession):
        updates, positions = split(batch)
        touched = add_raw(store, "raw_updates", updates, batch_id).union(
            add_raw(store, "raw_positions", positions, batch_id)
        )
        changed = resolve_snapshots(store, touched, batch_id, dims, params)
        if marts:
            recompute_dates(store, batch.sparkSession, changed, dims, params)


def run_stream(
    stream: DataFrame,
    store: Store,
    dims: Dimensions,
    params: Params = Params(),
    split: Split = read_snapshots,
    marts: bool = True,
    every: str | None = None,
) -> StreamingQuery:
    """Start the realtime job: all there is and stop, or a batch ``every`` so often."""
    writer = (
        stream.writeStream.foreachBatch(
            lambda batch, batch_id: process_batch(
                batch, batch_id, store, dims, params, split, marts
            )
        )
        .option("checkpointLocation", store.path("_checkpoint"))
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


# -- live windows -----------------------------------------------------------------------


def stop_hour_live(resolved: DataFrame, params: Params = Params()) -> DataFrame:
    """Running counts per stop and hour of event time on a watermarked stream.

    State is partial-aggregated before the shuffle and dropped after the watermark. The batch
    marts stay the truth for later rows.
    """
    return (
        resolved.where("stop_id is not null")
        .withWatermark("event_ts_utc", WATERMARK)
        .groupBy(F.window("event_ts_utc", "1 hour").alias("w"), "stop_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.avg(F.expr(f"if(abs(delay_sec) <= {params.on_time_sec}, 1, 0)")).alias(
                "pct_on_time"
            ),
            F.avg("delay_sec").alias("mean_delay_sec"),
        )
        .select(F.col("w.start").alias("window_start"), "stop_id", "n_events", "pct_on_time",
                "mean_delay_sec")
    )


def route_day_live(resolved: DataFrame, params: Params = Params()) -> DataFrame:
    """Running counts per route and local day on a watermarked stream."""
    local = resolved.withColumn(
        "local_ts", F.from_utc_timestamp("event_ts_utc", params.zone)
    )
    return (
        local.withWatermark("local_ts", WATERMARK)
        .groupBy(F.window("local_ts", "1 day").alias("w"), "route_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.avg(F.expr(f"if(abs(delay_sec) <= {params.on_time_sec}, 1, 0)")).alias(
                "pct_on_time"
            ),
        )
        .select(
            F.to_date("w.start").alias("service_date_mst"), "route_id", "n_events", "pct_on_time"
        )
    )


def snapshot_windows(updates: DataFrame, minutes: int = 5) -> DataFrame:
    """Rows per window of snapshot time, the streaming twin of the missing-window check."""
    return (
        updates.withWatermark("feed_ts_utc", WATERMARK)
        .groupBy(F.window("feed_ts_utc", f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def write_live(
    view: DataFrame, path: str, checkpoint: str, keys: list[str], partition: str
) -> StreamingQuery:
    """Keep a table at the newest value of every window; a window's later value replaces it."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            if not batch.isEmpty():
                tables.upsert(batch, path, keys, partition)

    return (
        view.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
