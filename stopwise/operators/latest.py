"""One row per key, chosen by an order, and exact-key dedup.

All of these are aggregates, so each task reduces its own rows before the shuffle and a hot
key costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], choose: str) -> DataFrame:
    columns = df.columns
    ranked = [*order, *(c for c in columns if c not in keys and c not in order)]
    row = ", ".join(f"`{c}`" for c in ranked)
    best = df.groupBy(*keys).agg(F.expr(f"{choose}(struct({row})) as _best"))
    return best.selectExpr(*[f"`{c}`" if c in keys else f"_best.`{c}`" for c in columns])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` values per key; NULL counts as smallest.

    Remaining ties fall to the greatest values of the other columns, so the choice does not
    depend on row order. Keys group NULL with NULL.
    """
    return _pick(df, keys, order, "max")


def first_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` values per key; NULL counts as smallest."""
    return _pick(df, keys, order, "min")


def newest_partition(df: DataFrame, column: str = "_extract_date") -> DataFrame:
    """Rows of the greatest ``column`` value.

    The scalar subquery runs first over that one column; on a table partitioned by it the
    outer scan then reads one partition.
    """
    latest = df.agg(F.max(column).alias("latest"))
    return df.where(F.col(column) == latest.scalar())
