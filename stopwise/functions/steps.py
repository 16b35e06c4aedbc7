"""Keeping long expressions evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that a later filter tests as they stand.

    A plain projected column is written out again inside every filter pushed below it. A
    one-row generator stops that: the expression is evaluated once per row.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
