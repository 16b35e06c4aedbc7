"""Census responses to demographic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.functions.safe import ratio, to_long

# Variable codes and geography prefixes.
VARIABLES = {
    "hh_no_vehicle": "B08201_002E",
    "hh_total": "B08201_001E",
    "workers_transit": "B08301_010E",
    "workers_total": "B08301_001E",
    "persons_poverty": "B17001_002E",
    "pop_total": "B01003_001E",
}
PREFIX = {"tract": "14000US", "bg": "15000US"}
SHARES = {
    "pct_hh_no_vehicle": ("hh_no_vehicle", "hh_total"),
    "pct_transit_commute": ("workers_transit", "workers_total"),
    "pct_poverty": ("persons_poverty", "pop_total"),
}


def demographics(rows: DataFrame, year: int, geography: str = "tract") -> DataFrame:
    """Counts as numbers, the geography id and the shares, NULL without a denominator."""
    parts = ["state", "county", "tract"] + (["block group"] if geography == "bg" else [])
    counts = rows.select(
        F.concat(F.lit(PREFIX[geography]), *[F.col(f"`{p}`") for p in parts]).alias("geoid"),
        F.col("NAME").alias("name"),
        F.lit(year).cast("long").alias("year"),
        *[to_long(F.col(code)).alias(name) for name, code in VARIABLES.items()],
    )
    return counts.withColumns(
        {n: ratio(F.col(a), F.col(b), 4) for n, (a, b) in SHARES.items()}
    )


def denominator_coverage(rows: DataFrame) -> DataFrame:
    """Share of rows whose denominator is positive, per denominator."""
    return rows.agg(
        *[
            F.avg(F.expr(f"if({c} > 0, 1, 0)")).alias(c)
            for c in ("hh_total", "workers_total", "pop_total")
        ]
    )
