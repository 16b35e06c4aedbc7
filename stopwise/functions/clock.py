"""Local time, service-day clock and date helpers.

Arguments are column names or SQL expressions. Local parts are computed from the shifted epoch,
so they do not depend on the session zone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weekday names in the order of dayofweek() - 1, Sunday first.
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def local_date(ts: str, zone: str) -> Column:
    """Calendar date of an instant in ``zone``."""
    return F.expr(
        "date_from_unix_date(cast("
        f"floor(unix_seconds(from_utc_timestamp({ts}, '{zone}')) / 86400) as int))"
    )


def local_hour(ts: str, zone: str) -> Column:
    """Hour 0-23 of an instant in ``zone``."""
    return F.expr(
        f"cast(pmod(unix_seconds(from_utc_timestamp({ts}, '{zone}')), 86400) div 3600 as int)"
    )


def utc_date(ts: str) -> Column:
    return F.expr(f"date_from_unix_date(cast(floor(unix_seconds({ts}) / 86400) as int))")


def seconds_between(later: str, earlier: str) -> Column:
    """Whole seconds from ``earlier`` to ``later``, truncated toward zero."""
    return F.expr(f"timestampdiff(SECOND, {earlier}, {later})")


def minutes_between(later: str, earlier: str) -> Column:
    return F.expr(f"timestampdiff(MINUTE, {earlier}, {later})")


def service_seconds(text: str) -> Column:
    """Seconds of ``HH:MM:SS`` on the service-day clock, where hours may pass 24.

    Missing or malformed text gives NULL.
    """
    h, m, s = (f"try_cast(try_element_at(split({text}, ':'), {i}) as int)" for i in (1, 2, 3))
    return F.expr(
        f"case when {h} >= 0 and {m} between 0 and 59 and {s} between 0 and 59 "
        f"then {h} * 3600L + {m} * 60 + {s} end"
    )


def service_instant(day: str, seconds: str, zone: str) -> Column:
    """Instant of service-clock seconds on a service date, read as wall-clock time in ``zone``."""
    return F.expr(
        f"to_utc_timestamp(timestamp_seconds(unix_date({day}) * 86400L + {seconds}), '{zone}')"
    )


def parse_yyyymmdd(text: str) -> Column:
    """Date of ``yyyymmdd`` text, NULL when it is not a date."""
    return F.expr(f"try_to_date({text}, 'yyyyMMdd')")


def weekday_name(day: str) -> Column:
    names = ", ".join(f"'{n}'" for n in WEEKDAYS)
    return F.expr(f"element_at(array({names}), dayofweek({day}))")


def runs_on(day: str) -> Column:
    """True when the 0/1 weekday column for ``day`` is set."""
    flags = ", ".join(f"coalesce({n} = 1, false)" for n in WEEKDAYS)
    return F.expr(f"element_at(array({flags}), dayofweek({day}))")


def date_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every date of an inclusive range with its weekday name and flags."""
    days = spark.range(1).select(
        F.expr(
            f"explode(sequence(date '{first}', date '{last}', interval 1 day)) as service_date"
        )
    )
    flags = [
        F.expr(f"dayofweek(service_date) = {i} as is_{name}")
        for i, name in enumerate(WEEKDAYS, start=1)
    ]
    return days.select(
        "service_date", weekday_name("service_date").alias("day_of_week"), *flags
    )
