"""Join helpers for hot and missing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 200_000


def never_matching(key: Column, *spread_by: Column) -> Column:
    """A text join key whose NULLs become scattered values that equal no real key.

    In an outer join every NULL key hashes to one task. These rows keep their place in the
    result and find no partner, but land on all tasks.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.hex(F.xxhash64(*spread_by))))


def join_splitting_hot_keys(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    rows_per_split: int = ROWS_PER_SPLIT,
    keep_split: bool = False,
) -> DataFrame:
    """Inner equi-join that divides the rows of hot keys of ``big`` over several tasks.

    Keys with more than ``rows_per_split`` rows get a split number from a hash of
    ``spread_by``; the rows of ``small`` with such a key are repeated once per split. There are
    at most rows / ``rows_per_split`` hot keys; whether their list is broadcast is left to Spark,
    which knows its size when it is joined. The result equals ``big.join(small, keys)``.

    With ``keep_split`` it has the column ``_split`` too, so that a grouping with the keys and that
    number needs no shuffle. ``small`` is then dealt by them even if Spark broadcasts ``big``: its
    tasks follow its own size, not that of what it was made of.
    """
    hot = (
        big.groupBy(*keys)
        .count()
        .where(F.col("count") > rows_per_split)
        .select(*keys, F.ceil(F.col("count") / rows_per_split).cast("int").alias("_splits"))
    )
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    big = (
        big.join(hot, list(keys), "left")
        .withColumn("_split", F.pmod(F.xxhash64(*spread_by), splits).cast("int"))
        .drop("_splits")
    )
    small = (
        small.join(hot, list(keys), "left")
        .withColumn("_split", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    if keep_split:
        return big.join(small.repartition(*keys, "_split"), [*keys, "_split"])
    return big.join(small, [*keys, "_split"]).drop("_split")
