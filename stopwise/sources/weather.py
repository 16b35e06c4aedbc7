"""Daily weather observations to one row per day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Observed types and the measure each becomes, with the size that betrays tenths.
MEASURES = {
    "SNOW": ("snow_mm", 200),
    "PRCP": ("precip_mm", 200),
    "TMIN": ("tmin_c", 100),
    "TMAX": ("tmax_c", 100),
    "TAVG": ("tavg_c", 100),
}
DEFAULT_STATION = "USW00023062"


def precip_bin(mm: str) -> Column:
    # Bin edges and names.
    return F.expr(
        f"case when {mm} <= 0 then 'none' when {mm} <= 5 then 'light' "
        f"when {mm} <= 20 then 'mod' when {mm} > 20 then 'heavy' end"
    )


def widen(observations: DataFrame, order: str | None = None) -> DataFrame:
    """Long observations (date, station, datatype, value) to one row per day and station.

    One aggregate. Of a repeated observation the last value by the ``order`` column counts, the
    greatest one where the order leaves a tie or there is no such column.
    """
    day = F.expr("try_to_date(substring(cast(date as string), 1, 10), 'yyyy-MM-dd')")
    value = F.col("value").try_cast("double")
    rank = F.lit(0) if order is None else F.col(order)
    return (
        observations.groupBy(day.alias("date"), "station")
        .agg(
            *[
                F.max(
                    F.when(
                        (F.col("datatype") == kind) & value.isNotNull(),
                        F.struct(rank.alias("rank"), value.alias("value")),
                    )
                )["value"].alias(name)
                for kind, (name, _) in MEASURES.items()
            ]
        )
        .where("date is not null")
    )


def from_local_csv(rows: DataFrame, start: date, end: date) -> DataFrame:
    """Wide station file (DATE, STATION and the observed types) cut to a date range."""
    day = F.expr("try_to_date(substring(cast(DATE as string), 1, 10), 'yyyy-MM-dd')")
    return rows.select(
        day.alias("date"),
        F.col("STATION").alias("station"),
        *[F.col(k).try_cast("double").alias(n) for k, (n, _) in MEASURES.items()],
    ).where(F.col("date").between(F.lit(start), F.lit(end)))


def fill_days(wide: DataFrame, start: date, end: date, station: str = DEFAULT_STATION) -> DataFrame:
    """Every day of the range; days without a row have no measures and the default station."""
    days = wide.sparkSession.range(1).select(
        F.expr(f"explode(sequence(date '{start}', date '{end}', interval 1 day)) as date")
    )
    return days.join(wide, "date", "left").withColumn(
        "station", F.coalesce("station", F.lit(station))
    )


def scale_units(wide: DataFrame) -> DataFrame:
    """Measures whose greatest size shows that they are in tenths, divided by ten as a whole."""
    largest = wide.agg(
        F.struct(*[F.max(F.abs(name)).alias(name) for name, _ in MEASURES.values()]).alias("m")
    )
    scaled = {
        name: F.expr(f"if(_m.{name} >= {limit}, {name} * 0.1D, {name})")
        for name, limit in MEASURES.values()
    }
    return wide.withColumn("_m", largest.scalar()).withColumns(scaled).drop("_m")


def derive(wide: DataFrame) -> DataFrame:
    """Mean temperature, snow flag and precipitation bin; measures rounded to two digits."""
    return wide.withColumn("tavg_c", F.expr("coalesce(tavg_c, (tmin_c + tmax_c) / 2)")).select(
        "date",
        "station",
        *[F.round(name, 2).alias(name) for name, _ in MEASURES.values()],
        F.expr("cast(snow_mm >= 1.0D as int)").cast("long").alias("snow_day"),
        precip_bin("precip_mm").alias("precip_bin"),
    )


def daily_weather(wide: DataFrame, start: date, end: date, station: str = DEFAULT_STATION):
    """Wide observations to the daily rows of a drop."""
    return derive(scale_units(fill_days(wide, start, end, station)))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing values per column."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
