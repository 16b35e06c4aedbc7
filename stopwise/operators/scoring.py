"""Scores and ranks over a whole relation without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BUCKETS = 4096


def _bounds(df: DataFrame, column: str) -> Column:
    """(lo, hi) of a column as one scalar subquery: two aggregates, one row."""
    stats = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b"))
    return stats.scalar()


def minmax_score(df: DataFrame, column: str, output: str, when_flat: float | None) -> DataFrame:
    """Scale a column to 0-100 with one decimal.

    When every value is equal all rows get ``when_flat``, rows with a NULL value included; otherwise NULL
    stays NULL.
    """
    flat = "null" if when_flat is None else f"{when_flat!r}D"
    scaled = f"({column} - _b.lo) / nullif(cast(_b.hi - _b.lo as double), 0D) * 100"
    score = f"round(cast(case when _b.hi = _b.lo then {flat} else {scaled} end as double), 1)"
    return (
        df.withColumn("_b", _bounds(df, column)).withColumn(output, F.expr(score)).drop("_b")
    )


def dense_rank_desc(
    df: DataFrame,
    column: str,
    output: str,
    low: float = 0.0,
    high: float = 100.0,
    buckets: int = RANK_BUCKETS,
) -> DataFrame:
    """Dense rank over the whole relation, greatest first, NULL last.

    Distinct values are cut into buckets of equal width between ``low`` and ``high``; values
    beyond them belong to the end buckets, so the rank is right for any value. Each bucket ranks
    its own values and adds the number of distinct values in higher buckets: only the
    ``buckets`` counts ever meet in one task.
    """
    place = f"floor(({column} - {low!r}D) / {(high - low) / buckets!r}D)"
    bucket = f"if({column} is null, -1, greatest(0, least({buckets - 1}, {place})))"
    values = df.select(column).distinct().withColumn("_bucket", F.expr(f"cast({bucket} as int)"))
    higher = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        values.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    )
    inside = Window.partitionBy("_bucket").orderBy(F.desc(column))
    ranks = values.join(F.broadcast(offsets), "_bucket").select(  # at most buckets + 1 rows
        F.col(column).alias("_value"),
        (F.col("_above") + F.row_number().over(inside)).alias(output),
    )
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def share_of_total(df: DataFrame, column: str) -> Column:
    """Column divided by its sum over the whole relation."""
    total = df.agg(F.sum(column).alias("total"))
    return F.col(column) / total.scalar()
