"""Registered queries: a plan, the columns it shows and the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.driver.model import Model
from stopwise.driver.sqltext import with_blocks
from stopwise.driver.views import Inputs

# How a column kind is shown by Spark and by SQL, so that both give the same type.
SPARK_KIND: dict[str, Callable[[Column], Column]] = {
    "s": lambda c: c.cast("string"),
    "i": lambda c: c.cast("long"),
    "b": lambda c: c.cast("int").cast("long"),
    "f": lambda c: F.round(c.cast("double"), 6),
    "p": lambda c: F.round(c.cast("double"), 8),
    "d": lambda c: c.cast("string"),
    "t": lambda c: F.unix_micros(c),
    "a": lambda c: F.concat_ws(",", c),
}
SQL_KIND = {
    "s": "CAST({c} AS VARCHAR)",
    "i": "CAST({c} AS BIGINT)",
    "b": "CAST({c} AS BIGINT)",
    "f": "round(CAST({c} AS DOUBLE), 6)",
    "p": "round(CAST({c} AS DOUBLE), 8)",
    "d": "CAST(CAST({c} AS DATE) AS VARCHAR)",
    "t": "epoch_us({c})",
    "a": "coalesce(array_to_string({c}, ','), '')",
}


@dataclass(frozen=True)
class Query:
    run: Callable[[Model], DataFrame]
    columns: str  # "name:kind ..."
    sql: str | None = None

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple(part.split(":")) for part in self.columns.split()]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(Model(Inputs(spark, sf_dir)))
        return df.select(*[SPARK_KIND[k](F.col(n)).alias(n) for n, k in self._columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(f"{SQL_KIND[k].format(c=n)} AS {n}" for n, k in self._columns())
        return with_blocks(f"SELECT {shown} FROM ({self.sql}) AS result")


QUERIES: dict[str, Query] = {}


def register(name: str, columns: str, sql: str | None = None):
    def keep(run: Callable[[Model], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = Query(run, columns, sql)
        return run

    return keep
