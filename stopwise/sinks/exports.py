"""Mart exports, their state, and raw drops with manifests."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.functions.clock import utc_date
from stopwise.operators.latest import newest
from stopwise.sinks import tables
from stopwise.sources.schemas import CSV_OPTIONS, EXPORT_STATE

DATE_COLUMN = "service_date_mst"
DROP_OPTIONS = {
    "header": "true",
    "compression": "gzip",
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
}


# -- state ------------------------------------------------------------------------------


def freshest_state(*stores: DataFrame) -> DataFrame:
    """Newest state per mart over several stores; a missing time counts as oldest."""
    together = stores[0]
    for other in stores[1:]:
        together = together.unionByName(other)
    return newest(together, ["mart_name"], ["last_run_ts"])


def read_state(spark: SparkSession, *paths: str) -> DataFrame:
    found = [t for p in paths if (t := tables.read_table(spark, p)) is not None]
    return freshest_state(*found) if found else spark.createDataFrame([], EXPORT_STATE)


def write_state(
    spark: SparkSession, path: str, mart: str, last_date: date | None, run_at: datetime
) -> None:
    """Replace the state of one mart; the table has one row per mart."""
    row = spark.createDataFrame([(mart, last_date, run_at)], EXPORT_STATE)
    old = tables.read_table(spark, path)
    if old is not None:
        row = row.unionByName(old.where(F.col("mart_name") != mart))
    tables.overwrite(tables.materialize(row, "export-state"), path)


# -- marts ------------------------------------------------------------------------------


def new_partitions(
    mart: DataFrame,
    last_exported: date | None,
    since: date | None = None,
    reexport_days: int = 0,
) -> DataFrame:
    """Dates to export: from ``since`` or the day after the last one, whichever is later.

    ``reexport_days`` goes back before the last exported date, for late corrections.
    """
    after = last_exported and last_exported + timedelta(days=1 - reexport_days)
    cutoff = max((d for d in (after, since) if d), default=None)
    dates = mart.select(DATE_COLUMN).where(F.col(DATE_COLUMN).isNotNull())
    if cutoff:
        dates = dates.where(F.col(DATE_COLUMN) >= F.lit(cutoff))
    return dates.distinct().orderBy(DATE_COLUMN)


def _state_of(spark: SparkSession, path: str, mart: str):
    state = read_state(spark, path).where(F.col("mart_name") == mart)
    return state.withColumn("run_day", utc_date("last_run_ts")).first()


def export_partitioned(
    mart: DataFrame,
    name: str,
    root: str,
    state_path: str,
    run_at: datetime,
    since: date | None = None,
    reexport_days: int = 0,
) -> list[date]:
    """Write one ``run_date=`` folder per new service date, all dates in one job."""
    spark = mart.sparkSession
    state = _state_of(spark, state_path, name)
    last = state.last_service_date if state else None
    dates = new_partitions(mart, last, since, reexport_days)
    found = [r[0] for r in dates.collect()]  # one value per service date
    if not found:
        return []
    rows = mart.where(F.col(DATE_COLUMN).isin(found)).withColumn("run_date", F.col(DATE_COLUMN))
    tables.overwrite_partitions(rows, f"{root}/{name}", "run_date", _spread(mart))
    write_state(spark, state_path, name, found[-1], run_at)
    return found


def _spread(mart: DataFrame) -> tuple[str, ...]:
    """Columns by which the rows of a date are dealt out, so that a task writes few files."""
    return tuple(c for c in ("route_id", "stop_id") if c in mart.columns) or (mart.columns[0],)


def export_snapshot(
    mart: DataFrame, name: str, root: str, state_path: str, run_at: datetime
) -> bool:
    """Write the whole mart as today's ``run_date=`` folder, at most once per UTC day."""
    spark = mart.sparkSession
    state = _state_of(spark, state_path, name)
    today = run_at.astimezone(UTC).date()
    if state and state.run_day and state.run_day >= today:
        return False
    rows = mart.withColumn("run_date", F.lit(today))
    tables.overwrite_partitions(rows, f"{root}/{name}", "run_date")
    write_state(spark, state_path, name, today, run_at)
    return True


def sync_state(marts: dict[str, DataFrame], synced_at: datetime, previous: dict | None = None):
    """Latest run date per refreshed mart merged over the previous state, as a JSON-ready dict."""
    state = dict(previous or {})
    known = dict(state.get("marts") or {})
    parts = [
        df.agg(F.max("run_date").cast("string").alias("latest")).select(
            F.lit(name).alias("mart"), "latest"
        )
        for name, df in marts.items()
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    known.update({r.mart: r.latest for r in together.collect() if r.latest})
    state["marts"] = known
    state["synced_at_utc"] = synced_at.astimezone(UTC).isoformat().replace("+00:00", "Z")
    state.setdefault("built_at_utc", None)
    return state


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


# -- raw drops --------------------------------------------------------------------------


def write_drop(
    rows: DataFrame, drop: str, file: str, quality: dict | None = None, written_at=None
) -> dict:
    """Write rows as gzip CSV parts below ``drop/file`` and a manifest beside them.

    The manifest has row count, size and MD5 of every part and is written last, so a drop with
    a manifest is complete.
    """
    files = write_parts(rows, drop, file)
    return write_manifest(rows.sparkSession, drop, files, quality, written_at)


def write_parts(rows: DataFrame, drop: str, file: str) -> dict[str, dict]:
    """Write rows as gzip CSV parts; returns the manifest entry of each part."""
    spark = rows.sparkSession
    target = f"{drop}/{file}"
    rows.write.mode("overwrite").options(**DROP_OPTIONS).csv(target)
    name = F.regexp_extract("_metadata.file_path", "([^/]+)$", 1).alias("part")
    counts = (
        spark.read.schema(rows.schema).options(**CSV_OPTIONS).csv(target)
        .select(name)
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    parts = (
        spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target)
        .select(
            F.regexp_extract("path", "([^/]+)$", 1).alias("part"),
            F.col("length").alias("bytes"),
            F.md5("content").alias("hash_md5"),
        )
        .join(counts, "part", "left")
        .select(
            F.concat(F.lit(f"{file}/"), "part").alias("name"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            "bytes",
            "hash_md5",
        )
    )
    return {r.name: {k: r[k] for k in ("row_count", "bytes", "hash_md5")} for r in parts.collect()}


def write_manifest(
    spark, drop: str, files: dict[str, dict], quality: dict | None = None, written_at=None
) -> dict:
    """Write the manifest of a drop whose files are complete."""
    manifest = {
        "files": files,
        "file_count": len(files),
        "row_count": sum(f["row_count"] for f in files.values()),
        "bytes": sum(f["bytes"] for f in files.values()),
        "schema_version": "v1",
        "written_at_utc": (written_at or datetime.now(UTC)).isoformat(),
        "quality": quality or {},
    }
    text = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{drop}/manifest.json"
    )
    return manifest
