"""Checks of a schedule drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns each file must have.
REQUIRED = {
    "stops.txt": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes.txt": ("route_id", "route_short_name", "route_long_name"),
    "trips.txt": ("trip_id", "route_id", "service_id"),
    "stop_times.txt": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
}


def validate(files: dict[str, DataFrame]) -> DataFrame:
    """One row per file: row count, missing columns, and whether it passes.

    Core files need all their columns and at least one row; a core file that is not given is
    listed with no rows.
    """

    def row(name: str) -> DataFrame:
        df = files.get(name)
        if df is None:
            df = next(iter(files.values())).limit(0)
            missing = list(REQUIRED[name])
        else:
            header = {c.strip().lstrip("﻿") for c in df.columns}
            missing = [c for c in REQUIRED.get(name, ()) if c not in header]
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("file"),
            "row_count",
            F.lit(",".join(sorted(missing))).alias("missing_columns"),
            (
                F.lit(not missing) & ((F.col("row_count") > 0) | F.lit(name not in REQUIRED))
            ).alias("valid"),
        )

    names = sorted({*files, *REQUIRED})
    return reduce(DataFrame.unionByName, [row(n) for n in names])
