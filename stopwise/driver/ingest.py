"""Raw drops of the given tables, loaded and streamed with a ledger, and through a death between."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.driver.catalog import register
from stopwise.driver.model import Model
from stopwise.session import shared_dir
from stopwise.sinks import exports, tables
from stopwise.sources import raw
from stopwise.sources.schemas import DATASETS, Dataset
from stopwise.streaming import realtime

SIDEWALKS = DATASETS["raw_sidewalks"]
AT = datetime(2024, 1, 31, 12, tzinfo=UTC)
DROPS = 4


def _columns(rows: DataFrame, dataset: Dataset, *more: str) -> DataFrame:
    """Rows in the columns of a raw dataset; what the view lacks is null."""
    return rows.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in rows.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in dataset.schema
        ],
        *more,
    )


def _sidewalk_drops(m: Model) -> str:
    """Sidewalks in one drop per extract date, dealt out by key."""
    root = shared_dir(m.inputs.spark, "drops")
    key = F.substring("sidewalk_id", 2, 20).cast("long") % DROPS
    rows = _columns(m.inputs.v_sidewalks.withColumn("_drop", key), SIDEWALKS, "_drop")
    rows = tables.materialize(rows, "sidewalks")
    for n in range(DROPS):
        drop = f"{root}/{SIDEWALKS.folder}/extract_date=2024-01-0{n + 1}"
        exports.write_drop(rows.where(F.col("_drop") == n).drop("_drop"), drop, SIDEWALKS.file)
    return root


@register(
    "raw_load",
    "extract_date:d load:i files:i n_rows:i ledger_rows:i sidewalks:i size_sum:i",
    f"""SELECT DATE '2024-01-01' + CAST(CAST(substring(sidewalk_id, 2) AS BIGINT) % {DROPS} AS INTEGER) AS extract_date,
               CASE WHEN CAST(substring(sidewalk_id, 2) AS BIGINT) % {DROPS} < 2 THEN 1 ELSE 2 END AS load,
               1 AS files, count(*) AS n_rows, count(*) AS ledger_rows, count(DISTINCT sidewalk_id) AS sidewalks,
               CAST(sum(length_m) AS BIGINT) AS size_sum
        FROM v_sidewalks GROUP BY ALL""",
)
def _raw_load(m: Model):
    """Two drops are loaded; a second load dies after its rows, is run again, and then has nothing to do."""
    spark, root = m.inputs.spark, _sidewalk_drops(m)
    target, ledger = f"{root}/table", f"{root}/ledger"
    raw.load(spark, root, SIDEWALKS, target, ledger, AT, date(2024, 1, 1), date(2024, 1, 2))
    # This one wrote the rows of one drop as load 2 and never its record.
    third = raw.list_files(spark, root, SIDEWALKS, date(2024, 1, 3), date(2024, 1, 3))
    raw.write_files(spark, SIDEWALKS, [(r.source_path, "") for r in third.collect()], target, 2, AT)
    for _ in range(2):
        raw.load(spark, root, SIDEWALKS, target, ledger, AT)
    rows = raw.committed(spark, target, ledger, SIDEWALKS)
    loaded = rows.groupBy(F.col("_extract_date").alias("extract_date"), "load").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sidewalk_id").alias("sidewalks"),
        F.sum("length_m").alias("size_sum"),
    )
    entries = raw.read_ledger(spark, ledger).groupBy(raw.extract_date("_source_path").alias("extract_date"), "load").agg(
        F.countDistinct(F.regexp_extract("_source_path", "(.*)/[^/]+$", 1)).alias("files"),
        F.sum("rows").alias("ledger_rows"),
    )
    return loaded.join(entries, ["extract_date", "load"], "full")


@register(
    "raw_load_plan",
    "extract_date:d status:s all_hashed:b n_rows:i",
    f"""SELECT DATE '2024-01-01' + CAST(CAST(substring(sidewalk_id, 2) AS BIGINT) % {DROPS} AS INTEGER) AS extract_date,
               CASE WHEN CAST(substring(sidewalk_id, 2) AS BIGINT) % {DROPS} = 0 THEN 'DONE'
                    WHEN CAST(substring(sidewalk_id, 2) AS BIGINT) % {DROPS} = 3 THEN 'SKIP' ELSE 'LOAD' END AS status,
               TRUE AS all_hashed, count(*) AS n_rows
        FROM v_sidewalks GROUP BY ALL""",
)
def _raw_load_plan(m: Model):
    """What a load within a range would take, of drops without manifests: hashes are those of the bytes."""
    spark, root = m.inputs.spark, _sidewalk_drops(m)
    ledger, hashes = f"{root}/ledger", f"{root}/hashes"
    raw.load(spark, root, SIDEWALKS, f"{root}/table", ledger, AT, date(2024, 1, 1), date(2024, 1, 1))
    listed = raw.manifests(spark, root, SIDEWALKS)
    files = raw.list_files(spark, root, SIDEWALKS)
    hashed = raw.file_hashes(files, None, raw.contents(spark, root, SIDEWALKS), hashes)
    plan = raw.load_plan(hashed, raw.read_ledger(spark, ledger), None, date(2024, 1, 3))
    told = listed.select("drop", "name", F.col("hash_md5").alias("_told"), "row_count")
    return plan.join(told, ["drop", "name"], "left").groupBy("extract_date", "status").agg(
        F.bool_and(F.col("hash_md5") == F.col("_told")).alias("all_hashed"), F.sum("row_count").alias("n_rows")
    )


def _ledger_sql(view: str, name: str) -> str:
    return f"""SELECT '{name}' AS table_name, DATE '2024-01-01' + CAST(hour(feed_ts_utc) % {DROPS} AS INTEGER) AS extract_date,
                      count(*) AS ledger_rows, count(*) AS n_rows, count(DISTINCT entity_id) AS entities, 0 AS unhashed
               FROM {view} GROUP BY ALL"""


@register(
    "rt_stream_ledger",
    "table_name:s extract_date:d ledger_rows:i n_rows:i entities:i unhashed:i",
    f"{_ledger_sql('v_updates', 'raw_updates')} UNION ALL {_ledger_sql('v_positions', 'raw_positions')}",
)
def _rt_stream_ledger(m: Model):
    """Snapshots arrive with manifests; one of them is half written at first, and the first batch has a
    dead attempt behind it."""
    spark, root = m.inputs.spark, shared_dir(m.inputs.spark, "drops")
    store = realtime.Store(shared_dir(spark, "realtime"))
    dims = realtime.Dimensions(m.trips, m.patterns, m.scheduled_headways, m.weather_days)
    place = F.hour("feed_ts_utc") % DROPS
    feeds = {
        d: tables.materialize(_columns(v.withColumn("_drop", place), d, "_drop"), "feed")
        for d, v in ((realtime.UPDATES, m.inputs.v_updates), (realtime.POSITIONS, m.inputs.v_positions))
    }
    drops = [f"{root}/{realtime.UPDATES.folder}/snapshot_at=2024-01-0{n + 1}T00:00" for n in range(DROPS)]
    named: list[dict] = []
    for n, drop in enumerate(drops):
        named.append({})
        for dataset, rows in feeds.items():
            named[n] |= exports.write_parts(rows.where(F.col("_drop") == n).drop("_drop"), drop, dataset.file)

    def run() -> None:
        stream = realtime.snapshot_manifests(spark, root)
        realtime.run_stream(stream, store, dims, m.params, realtime.read_manifests, marts=False).awaitTermination()

    # Two drops are complete, and an attempt at them died with other rows in its folder.
    for n in (0, 1):
        exports.write_manifest(spark, drops[n], named[n])
    dead = feeds[realtime.UPDATES].where("_drop = 2").drop("_drop").withColumns(
        {"feed_date": F.to_date("feed_ts_utc"), "_file": F.lit(0)}
    )
    tables.write_load(dead, store.path("raw_updates"), "batch", 0, "feed_date")
    run()
    for n in (2, 3):
        exports.write_manifest(spark, drops[n], named[n])
    run()
    ledger = store.read(spark, "ledger").groupBy(
        F.col("table").alias("table_name"), raw.extract_date("_source_path").alias("extract_date")
    ).agg(F.sum("rows").alias("ledger_rows"))
    loaded = None
    for name in ("raw_updates", "raw_positions"):
        own = store.read(spark, name).groupBy(F.lit(name).alias("table_name"), F.col("_extract_date").alias("extract_date")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("entities"),
            F.count_if(F.col("_hash_md5").isNull()).alias("unhashed"),
        )
        loaded = own if loaded is None else loaded.unionByName(own)
    return loaded.join(ledger, ["table_name", "extract_date"], "full")


_MART_SQL = """SELECT DATE '2024-01-01' + CAST(o_orderkey % 5 AS INTEGER) AS run_date, o_orderkey AS v FROM orders"""


def _scan_sql(scan: str, where: str) -> str:
    """Dates 1 and 2 are as first exported, the third was corrected, the others came with it."""
    return f"""SELECT '{scan}' AS scan, run_date, count(*) AS n_rows,
                      CAST(sum(v + CASE WHEN run_date >= DATE '2024-01-03' THEN 1 ELSE 0 END) AS BIGINT) AS total
               FROM mart WHERE {where} GROUP BY run_date"""


@register(
    "mart_export_scan",
    "scan:s run_date:d n_rows:i total:i",
    f"""WITH mart AS ({_MART_SQL})
        {_scan_sql('all', 'true')} UNION ALL {_scan_sql('stale', 'true')}
        UNION ALL {_scan_sql('latest', "run_date = (SELECT max(run_date) FROM mart)")}
        UNION ALL {_scan_sql('recent', "run_date >= DATE '2024-01-06' - 2")}
        UNION ALL SELECT 'snapshot', DATE '2024-01-04', count(*), CAST(sum(v) AS BIGINT) FROM mart
                  WHERE run_date <= DATE '2024-01-03' HAVING count(*) > 0
        UNION ALL SELECT 'state events', max(run_date), count(DISTINCT run_date), 1 FROM mart
        UNION ALL SELECT 'state places', DATE '2024-01-04', 1, 1
        UNION ALL SELECT 'synced events', max(run_date), 1, 1 FROM mart""",
)
def _mart_export_scan(m: Model):
    """Three dates are exported, then the rest with the last one again, then nothing; a snapshot is
    written once a day; what was exported is scanned whole, by age and for its latest date."""
    spark, root = m.inputs.spark, shared_dir(m.inputs.spark, "exports")
    state, later = f"{root}/state", datetime(2024, 1, 6, 12, tzinfo=UTC)
    mart = m.inputs.orders.selectExpr(
        "cast(o_custkey % 40 as string) as route_id",
        "date_add(date'2024-01-01', cast(o_orderkey % 5 as int)) as service_date_mst",
        "o_orderkey as v",
    )
    first = mart.where("service_date_mst <= date'2024-01-03'")
    corrected = mart.withColumn("v", F.col("v") + 1)
    early = datetime(2024, 1, 4, 12, tzinfo=UTC)
    dates = exports.export_partitioned(first, "events", root, state, early)
    dates += exports.export_partitioned(corrected, "events", root, state, later, reexport_days=1)
    dates += exports.export_partitioned(corrected, "events", root, state, later)
    exports.export_snapshot(first, "places", root, state, early)
    exports.export_snapshot(corrected, "places", root, state, early)

    def scanned(scan: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy("run_date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("total")).select(
            F.lit(scan).alias("scan"), "run_date", "n_rows", "total"
        )

    whole = raw.mart_scan(spark, root, "events", max_age_days=None)
    out = scanned("all", whole)
    for scan, mart_name, how in (
        ("stale", "events", {"today": date(2024, 6, 1)}),
        ("latest", "events", {"latest_only": True}),
        ("recent", "events", {"max_age_days": 2, "today": date(2024, 1, 6)}),
        ("snapshot", "places", {"max_age_days": None}),
    ):
        out = out.unionByName(scanned(scan, raw.mart_scan(spark, root, mart_name, **how)))
    exported = {"events": len(set(dates)), "places": 1}
    for name, n in exported.items():
        own = exports.read_state(spark, state).where(F.col("mart_name") == name)
        out = out.unionByName(own.groupBy(F.col("last_service_date").alias("run_date")).agg(
            F.lit(n).alias("n_rows"), F.count(F.lit(1)).alias("total")
        ).withColumn("scan", F.lit(f"state {name}")))
    synced = exports.sync_state({"events": whole}, later)["marts"]
    last = spark.createDataFrame(list(synced.items()), "mart string, run_date string").selectExpr(
        "'synced ' || mart as scan", "cast(run_date as date) as run_date", "1 as n_rows", "1 as total"
    )
    return out.unionByName(last)
