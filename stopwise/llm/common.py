"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import stopwise
from stopwise.session import shared_dir

_shipped: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, as ``--py-files`` would."""
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(stopwise.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="run-"), "stopwise.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted([*root.rglob("*.py"), *root.rglob("texts/*.txt")]):
                out.write(file, Path(root.name, file.relative_to(root)))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(spark.sparkContext.applicationId)
    return spark


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a relation once into the shared folder and go on from the written table."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.stored_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Drop tables made by ``stored`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def body(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def release(spark: SparkSession) -> None:
    """Let the driver forget plans that it no longer holds, so that their shuffle files go.

    Called between the written steps of a long job: files of a finished step are otherwise
    kept until the driver happens to collect its garbage.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
