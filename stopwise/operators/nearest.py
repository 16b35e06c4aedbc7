"""Nearest match in time, looking both ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.functions.clock import seconds_between


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_value: str,
) -> DataFrame:
    """Each left row with the right row of the same keys closest in time.

    Adds ``right_ts``, ``right_value`` and ``dt_abs`` (whole seconds). NULL keys match NULL.
    Left rows without any partner are dropped; equal distances take the earlier right row. Right
    rows have distinct times per key.

    Both sides share one partitioning, sorted by time once in each direction. In both orders a
    left row takes the last right row so far, and such running frames keep one value, so the cost
    is that of sorting and does not grow with the pairs per key. The caller's
    keys must include the service date: with whole-second times a key then holds at most a day
    of seconds from either side.
    """
    payload = F.struct(F.col(right_ts).alias("ts"), F.col(right_value).alias("value"))
    extra = [c for c in left.columns if c not in keys]
    both = left.select(
        *keys,
        F.col(left_ts).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*extra).alias("_left"),
        F.lit(None).cast(
            f"struct<ts:timestamp,value:{dict(right.dtypes)[right_value]}>"
        ).alias("_right"),
    ).unionByName(
        right.select(
            *keys,
            F.col(right_ts).alias("_at"),
            F.lit(0).alias("_side"),
            F.lit(None).cast(left.select(F.struct(*extra).alias("s")).schema["s"].dataType).alias(
                "_left"
            ),
            payload.alias("_right"),
        )
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(*so_far)
    ahead = (
        Window.partitionBy(*keys).orderBy(F.desc("_at"), F.asc("_side")).rowsBetween(*so_far)
    )
    gap_back = F.abs(seconds_between("_at", "_before.ts"))
    gap_ahead = F.abs(seconds_between("_at", "_after.ts"))
    use_before = F.col("_after").isNull() | (gap_back <= gap_ahead)
    best = F.when(F.col("_before").isNotNull() & use_before, F.col("_before")).otherwise(
        F.col("_after")
    )
    return (
        both.withColumn("_before", F.last("_right", ignorenulls=True).over(back))
        .withColumn("_after", F.last("_right", ignorenulls=True).over(ahead))
        .where("_side = 1 and (_before is not null or _after is not null)")
        .withColumn("_best", best)
        .select(
            *[F.col(c) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns],
            F.col("_best.ts").alias(right_ts),
            F.col("_best.value").alias(right_value),
            F.abs(seconds_between("_at", "_best.ts")).alias("dt_abs"),
        )
    )
