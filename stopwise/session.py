"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# UTC keeps wall-clock expressions independent of the machine. AQE re-plans joins from
# measured sizes, splits skewed join partitions and coalesces small ones.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where a grouping above then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Grid joins and schedule expansion make many rows out of few bytes: keep small partitions.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # For the same reason more tasks, not larger ones, as inputs grow: by default a task's share may reach 64m,
    # or a 200th of any shuffle, which are gigabytes once dates or cells have multiplied its rows.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Quantile and mode states are small; keep hashing instead of sorting every row.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


# Settings that only a new session takes. The call sites of column expressions are not recorded,
# which makes building a plan several times faster.
BUILD_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else made."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("stopwise")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **BUILD_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local session may name none and then gets a temporary folder; on a cluster that is an
    error, since the driver's disk is not the executors'.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stopwise-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4()}"
    if _scratch:
        _scratch[-1].append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written to the shared folder inside the block are dropped at its end."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _scratch.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
