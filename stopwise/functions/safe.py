"""Casts and divisions that give NULL instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def to_long(value: Column) -> Column:
    return value.try_cast("long")


def to_double(value: Column) -> Column:
    return value.try_cast("double")


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """``numerator / denominator``, NULL unless the denominator is positive."""
    value = F.when(denominator > 0, numerator / F.nullif(denominator, F.lit(0)))
    return value if digits is None else F.round(value, digits)


def flag(value: Column) -> Column:
    """Loose text or number as 0/1: whole number other than zero, or true / t / yes."""
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("long")
    return (
        F.when(value.isNull() | (text == ""), 0)
        .when(number.isNotNull(), (number != 0).cast("int"))
        .otherwise(text.isin("true", "t", "yes").cast("int"))
    )


def clean_text(value: Column) -> Column:
    """Trimmed lower-case text, empty when missing."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
