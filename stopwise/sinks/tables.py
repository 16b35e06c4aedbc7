"""Writing tables: append, overwrite, partition overwrite and keyed upsert on Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stopwise.operators.latest import newest
from stopwise.session import shared_dir


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a relation once into the shared folder and continue from the written table."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(
    df: DataFrame, path: str, partition: str | None = None, cluster: Sequence[str] = ()
) -> None:
    """Append rows, one folder per partition value, ordered by the cluster columns inside files.

    Rows are spread by partition and cluster columns together, so one big day is written by many
    tasks and a file still covers a narrow range of the cluster columns.
    """
    _writer(df, partition, cluster).mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a whole table, as for a full-refresh snapshot."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def overwrite_partitions(
    df: DataFrame, path: str, partition: str | Sequence[str], cluster: Sequence[str] = ()
) -> None:
    """Replace the partitions that occur in ``df`` and keep all others."""
    writer = _writer(df, partition, cluster)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _writer(df: DataFrame, partition: str | Sequence[str] | None, cluster: Sequence[str]):
    folders = [partition] if isinstance(partition, str) else list(partition or ())
    if cluster:
        df = df.repartition(*folders, *cluster).sortWithinPartitions(*folders, *cluster)
    return df.write.partitionBy(*folders) if folders else df.write


#: Files of a portion: their paths go to a reader together, and one histogram counts them.
FILES = 1_000


def write_load(
    rows: DataFrame,
    path: str,
    load: str,
    number: int,
    partition: str,
    cluster: Sequence[str] = (),
    files: int = 1,
) -> list[int]:
    """Replace one load of a table, which has the folder ``load=number`` to itself.

    An earlier attempt of the same load leaves nothing behind. Returns the rows of each of the
    ``files`` that ``_file`` numbers. The tasks that write them count them: histograms with a bin
    per file, observed behind the last shuffle, where a task counts only when it succeeds.
    """
    if cluster:
        rows = rows.repartition(partition, *cluster).sortWithinPartitions(partition, *cluster)
    seen = Observation()
    portions = range(0, max(files, 1), FILES)
    bins = [
        F.expr(f"histogram_numeric(if(_file between {i} and {i + FILES - 1}, _file, null), {FILES})")
        for i in portions
    ]
    counted = rows.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        *[b.alias(f"files{i}") for i, b in zip(portions, bins, strict=True)],
    )
    writer = counted.drop("_file").write.mode("overwrite").partitionBy(partition)
    writer.option("partitionOverwriteMode", "static").parquet(f"{path}/{load}={number}")
    counts = [0] * files
    for i in portions:
        for place, n in seen.get[f"files{i}"] or []:
            counts[round(place)] += round(n)
    if sum(counts) != seen.get["rows"]:
        raise ValueError(f"{seen.get['rows']} rows written, {sum(counts)} of known files")
    return counts


def commit_load(entries: DataFrame, ledger: str, table: str, load: str, number: int) -> None:
    """Record a load: one file, which is there whole or not at all."""
    writer = entries.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.parquet(f"{ledger}/table={table}/{load}={number}")


def upsert(
    new: DataFrame,
    path: str,
    keys: Sequence[str],
    partition: str,
    lookback: str | None = None,
    cluster: Sequence[str] = (),
) -> None:
    """Update rows with a known key and insert the others.

    Without ``lookback`` a key never changes its partition and only partitions that occur in
    ``new`` are read. With it, the filter names the partitions in which an older row of a key may
    lie; a key that moved then leaves its old partition. The merged partitions are written to
    the shared folder first, as a plan cannot overwrite what it reads; a lost executor repeats
    either step from files. Several rows of one key in ``new`` are an error of the caller.
    """
    spark = new.sparkSession
    old = read_table(spark, path)
    if old is None:
        overwrite_partitions(new, path, partition, cluster)
        return
    staged = materialize(new.withColumn("_age", F.lit(1)), "upsert-new")
    old = old.select(*new.columns).withColumn("_age", F.lit(0))
    if lookback:
        old = old.where(lookback)
    else:
        old = old.join(F.broadcast(staged.select(partition).distinct()), partition, "left_semi")
    merged = newest(old.unionByName(staged), keys, ["_age"])
    result = materialize(merged.select(*new.columns), "upsert-merged")
    emptied = []
    if lookback:  # keys may have left a partition; one value per partition comes back
        kept = result.select(partition).distinct()
        emptied = old.select(partition).distinct().join(kept, partition, "left_anti").collect()
    overwrite_partitions(result, path, partition, cluster)
    drop_partitions(spark, path, partition, [r[0] for r in emptied])


def drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Remove the folders of some partition values, if they are there."""
    jvm = spark.sparkContext._jvm
    for value in values:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def replace_relation(df: DataFrame, name: str, hot: bool, path: str | None = None) -> None:
    """Register a mart as a stored table (hot) or as a view, dropping the other kind first."""
    spark = df.sparkSession
    if hot:
        spark.catalog.dropTempView(name)
        writer = df.write.mode("overwrite").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    else:
        spark.sql(f"drop table if exists {name}")
        df.createOrReplaceTempView(name)
