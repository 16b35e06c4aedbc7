"""Raw drops: discovery, hashes, load plan, scan with provenance, and the load itself."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from stopwise.functions.clock import utc_date
from stopwise.operators.latest import newest
from stopwise.sinks import tables
from stopwise.sources.schemas import (
    CSV_OPTIONS,
    DAY_FOLDER,
    FILE_HASHES,
    LEDGER,
    MANIFEST,
    Dataset,
)


def drop_glob(
    root: str, dataset: Dataset, start: date | None = None, end: date | None = None
) -> str:
    """Path glob of the drops, one alternative per day when a range is given."""
    label = "*"
    if start or end:
        lo, hi = sorted((start or end, end or start))
        days = [(lo + timedelta(days=i)).isoformat() for i in range((hi - lo).days + 1)]
        suffix = "*" if dataset.label == "snapshot_at" else ""
        label = "{" + ",".join(d + suffix for d in days) + "}"
    return f"{root.rstrip('/')}/{dataset.folder}/{dataset.label}={label}"


def _open_drops(
    reader: DataFrameReader,
    root: str,
    dataset: Dataset,
    leaf: str,
    start: date | None,
    end: date | None,
) -> tuple[DataFrameReader, str]:
    """Reader and path for one file name in all drops of a range.

    The minute label of a snapshot has a colon, which a path glob cannot hold: those folders are
    listed as a tree, and the range is a filter on the listed paths.
    """
    if dataset.label == "extract_date":
        return reader, f"{drop_glob(root, dataset, start, end)}/{leaf}"
    names = "{manifest.json,part-*.txt}" if leaf == "manifest.json" else "*.csv.gz"
    tree = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    return tree, f"{root.rstrip('/')}/{dataset.folder}"


def _in_drops(df: DataFrame, path: str, leaf: str, start: date | None, end: date | None):
    df = df.where(F.contains(path, F.lit(f"/{leaf}")))
    day = extract_date(path)
    if start or end:
        lo, hi = sorted((start or end, end or start))
        df = df.where(day.isNull() | day.between(F.lit(lo), F.lit(hi)))
    return df


def extract_date(path: str) -> Column:
    """Date of the ``extract_date=`` or ``snapshot_at=`` label in a path; NULL when malformed."""
    label = f"regexp_extract({path}, '(?:extract_date|snapshot_at)=([^/T]*)', 1)"
    return F.expr(f"try_to_date({label}, 'yyyy-MM-dd')")


def _split_path(df: DataFrame, path: str) -> DataFrame:
    """Drop folder and the file's name below it, which is its key in the manifest."""
    parts = "(.*/(?:extract_date|snapshot_at)=[^/]+)/(.+)$"
    return df.withColumns(
        {
            "drop": F.regexp_extract(path, parts, 1),
            "name": F.regexp_extract(path, parts, 2),
        }
    )


def list_files(
    spark: SparkSession,
    root: str,
    dataset: Dataset,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """One row per data file: path, extract date, size. File contents are not read."""
    reader, path = _open_drops(
        spark.read.format("binaryFile"), root, dataset, dataset.file, start, end
    )
    found = reader.load(path).select("path", "length", "modificationTime")
    found = _in_drops(found, "path", dataset.file, start, end)
    return _split_path(found, "path").select(
        F.lit(dataset.table).alias("table"),
        F.col("path").alias("source_path"),
        "drop",
        "name",
        extract_date("path").alias("extract_date"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def contents(
    spark: SparkSession,
    root: str,
    dataset: Dataset,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """The same files with their bytes, as rows of the binary source."""
    reader, path = _open_drops(
        spark.read.format("binaryFile"), root, dataset, dataset.file, start, end
    )
    return _in_drops(reader.load(path), "path", dataset.file, start, end)


def manifests(
    spark: SparkSession,
    root: str,
    dataset: Dataset,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """One row per file named in a manifest: drop, name, row_count, bytes, hash_md5.

    A manifest that is not JSON counts as absent.
    """
    read = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE")
    reader, path = _open_drops(read, root, dataset, "manifest.json", start, end)
    rows = reader.json(path).select(F.url_decode("_metadata.file_path").alias("path"), "files")
    rows = _in_drops(rows, "path", "manifest.json", start, end)
    return rows.select(
        F.regexp_replace("path", "/manifest\\.json(/[^/]*)?$", "").alias("drop"),
        F.explode("files").alias("name", "entry"),
    ).select("drop", "name", "entry.*")


def file_hashes(
    files: DataFrame, listed: DataFrame | None, bytes_of: DataFrame, store: str
) -> DataFrame:
    """Files with ``hash_md5``: the manifest's when it has one, else of the bytes.

    Hashes of bytes are kept in a table at ``store`` by path, size and time of change; a file that is
    known there is not read again. For the others the folders are read by the time of the oldest of
    them: what did not change since then is not opened, and no path comes to the driver.
    """
    spark, key = files.sparkSession, ["source_path", "bytes", "modified"]
    known = files.withColumn("hash_md5", F.lit(None).cast("string"))
    if listed is not None:
        hashes = listed.select("drop", "name", F.nullif("hash_md5", F.lit("")).alias("hash_md5"))
        known = files.join(hashes, ["drop", "name"], "left")
    known = tables.materialize(known, "listed-files")
    kept = tables.read_table(spark, store)
    if kept is None:
        kept = spark.createDataFrame([], FILE_HASHES)
    absent = known.where("hash_md5 is null").select(*key).join(kept, key, "left_anti")
    oldest = absent.agg(F.min(F.unix_micros("modified"))).first()[0]
    if oldest is not None:
        read = bytes_of.where(F.col("modificationTime") >= F.timestamp_micros(F.lit(oldest))).select(
            F.col("path").alias("source_path"),
            F.col("length").alias("bytes"),
            F.col("modificationTime").alias("modified"),
            F.md5("content").alias("hash_md5"),
        )
        tables.append(read.join(absent, key, "left_semi"), store)
        kept = tables.read_table(spark, store)
    own = kept.dropDuplicates(key).withColumnRenamed("hash_md5", "_md5")
    return known.join(own, key, "left").withColumn(
        "hash_md5", F.coalesce("hash_md5", "_md5")
    ).drop("_md5")


def load_plan(
    files: DataFrame, ledger: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Every candidate file as LOAD, SKIP (outside the range) or DONE (same path and hash)."""
    done = ledger.select(
        F.col("_source_path").alias("source_path"),
        F.col("_hash_md5").alias("hash_md5"),
        F.lit(True).alias("_done"),
    ).distinct()
    day = F.col("extract_date")
    early = F.lit(False) if start is None else day < F.lit(start)
    late = F.lit(False) if end is None else day > F.lit(end)
    status = (
        F.when(early | late, "SKIP").when(F.col("_done"), "DONE").otherwise("LOAD")
    )
    reason = (
        F.when(early, F.concat(day.cast("string"), F.lit(f" is before {start}")))
        .when(late, F.concat(day.cast("string"), F.lit(f" is after {end}")))
        .when(F.col("_done"), "same file in the ledger")
    )
    return (
        files.join(done, ["source_path", "hash_md5"], "left")
        .withColumns({"status": status, "reason": reason})
        .drop("_done")
    )


def to_load(plan: DataFrame, max_files: int | None = None) -> DataFrame:
    """The files of a plan to load in this run, only the first ones if the caller says how many."""
    new = plan.where("status = 'LOAD'")
    return new if max_files is None else new.orderBy("source_path").limit(max_files)


def read_files(spark: SparkSession, dataset: Dataset, paths: list[str], strict: bool) -> DataFrame:
    """CSV rows of some files with the declared schema; strict reading fails on malformed rows."""
    reader = spark.read.schema(dataset.schema).options(**CSV_OPTIONS)
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return reader.option("mode", mode).csv(paths)


def with_provenance(rows: DataFrame, hashes: DataFrame, loaded_at: datetime) -> DataFrame:
    """Rows with load time, source path, extract date (else load date) and file hash.

    ``hashes`` has one row per file of the run, and may number them (``_file``); Spark picks the join
    from its size.
    """
    marked = rows.withColumn("_source_path", F.col("_metadata.file_path"))
    number = [c for c in hashes.columns if c == "_file"]
    names = hashes.select(
        _plain_path(F.col("source_path")).alias("_key"), F.col("hash_md5").alias("_hash_md5"), *number
    )
    day = F.coalesce(extract_date("_source_path"), utc_date("_ingested_at"))
    return (
        marked.withColumn("_key", _plain_path(F.col("_source_path")))
        .join(names, "_key", "left")
        .withColumn("_ingested_at", F.lit(loaded_at))
        .withColumn("_extract_date", day)
        .select(*rows.columns, "_ingested_at", "_source_path", "_extract_date", "_hash_md5",
                *number)
    )


def _plain_path(path: Column) -> Column:
    """Local paths come as ``file:/x`` and ``file:///x``; both read the same here."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Every file of every committed load."""
    found = tables.read_table(spark, path)
    return spark.createDataFrame([], f"{LEDGER}, load int") if found is None else found


def committed(
    spark: SparkSession, target: str, ledger_path: str, dataset: Dataset
) -> DataFrame | None:
    """The raw table without what a load that died has left.

    Loads are numbered in a row, so the ledger's last number tells them apart, and later folders
    are pruned.
    """
    rows = tables.read_table(spark, target)
    return None if rows is None else rows.where(F.col("load") <= _last_load(spark, ledger_path, dataset))


def _last_load(spark: SparkSession, ledger_path: str, dataset: Dataset) -> int:
    own = read_ledger(spark, ledger_path).where(F.col("table") == dataset.table)
    return own.agg(F.max("load")).first()[0] or 0


def write_files(
    spark: SparkSession,
    dataset: Dataset,
    files: list[tuple[str, str]],
    target: str,
    number: int,
    loaded_at: datetime,
) -> DataFrame:
    """Write the rows of some files (path, hash) as one load; returns its ledger entries.

    Rows are counted by the write itself. Nothing is committed yet: the same number may be written
    again.
    """
    numbered = [(path, md5, i) for i, (path, md5) in enumerate(files)]
    hashes = spark.createDataFrame(numbered, "source_path string, hash_md5 string, _file int")
    paths = [path for path, _ in files]
    rows = with_provenance(read_files(spark, dataset, paths, True), hashes, loaded_at)
    day = DAY_FOLDER[dataset.partition] if dataset.partition else "_extract_date"
    if day not in rows.columns:
        rows = rows.withColumn(day, utc_date(dataset.partition))
    counts = tables.write_load(rows, target, "load", number, day, dataset.cluster, len(files))
    return spark.createDataFrame(
        [(path, md5, loaded_at, n) for (path, md5), n in zip(files, counts, strict=True)],
        "_source_path string, _hash_md5 string, _loaded_at timestamp, rows long",
    )


def load(
    spark: SparkSession,
    root: str,
    dataset: Dataset,
    target: str,
    ledger_path: str,
    loaded_at: datetime,
    start: date | None = None,
    end: date | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Load the new files of a dataset into its raw table and record them in the ledger.

    Returns the plan. Files are taken in portions of ``tables.FILES``, each a load with a number, a
    folder and a ledger record of its own. The record is written last. A run that dies before it leaves
    a folder that no reader of ``committed`` sees and that the next run replaces, since it takes
    the same number; so every row is in the table once.
    """
    found = list_files(spark, root, dataset, start, end)
    try:
        listed = manifests(spark, root, dataset, start, end)
    except Exception as error:  # no drop has a manifest
        if "PATH_NOT_FOUND" not in str(error):
            raise
        listed = None
    bytes_of = contents(spark, root, dataset, start, end)
    hashed = file_hashes(found, listed, bytes_of, f"{ledger_path.rstrip('/')}_hashes")
    ledger = read_ledger(spark, ledger_path)
    plan = tables.materialize(load_plan(hashed, ledger, start, end), "load-plan")
    chosen = to_load(plan, max_files).select("source_path", "hash_md5")
    number, last = _last_load(spark, ledger_path, dataset), ""
    while True:
        rest = chosen.where(F.col("source_path") > last).orderBy("source_path")
        files = [tuple(r) for r in rest.limit(tables.FILES).collect()]
        if not files:
            return plan
        number, last = number + 1, files[-1][0]
        entries = write_files(spark, dataset, files, target, number, loaded_at)
        tables.commit_load(entries, ledger_path, dataset.table, "load", number)


def source_freshness(raw: DataFrame, now: datetime, warn_days: int = 2, error_days: int = 5):
    """Age of the newest load with its grade."""
    age = (F.unix_seconds(F.lit(now)) - F.unix_seconds("latest")) / 86_400.0
    return raw.agg(F.max("_ingested_at").alias("latest")).select(
        "latest",
        age.alias("age_days"),
        F.when(F.col("latest").isNull() | (age > error_days), "error")
        .when(age > warn_days, "warn")
        .otherwise("pass")
        .alias("grade"),
    )


def mart_scan(
    spark: SparkSession,
    root: str,
    mart: str,
    latest_only: bool = False,
    max_age_days: int | None = 90,
    today: date | None = None,
) -> DataFrame:
    """Exported mart over chosen ``run_date=`` partitions.

    Latest only, or those within the maximum age; all of them when that would leave none. Run
    dates come from the folder names alone, and the choice prunes the folders that are read.
    """
    rows = spark.read.option("basePath", f"{root}/{mart}").parquet(f"{root}/{mart}/run_date=*")
    run_date = F.col("run_date")
    if latest_only:
        return rows.where(run_date == rows.agg(F.max("run_date").alias("r")).scalar())
    if max_age_days:
        cutoff = (today or date.today()) - timedelta(days=max_age_days)
        newest_run = rows.agg(F.max("run_date").alias("r")).scalar()
        return rows.where((run_date >= F.lit(cutoff)) | (newest_run < F.lit(cutoff)))
    return rows


def ledger_latest(ledger: DataFrame) -> DataFrame:
    """Newest ledger entry per source path."""
    return newest(ledger, ["_source_path"], ["_loaded_at"])
