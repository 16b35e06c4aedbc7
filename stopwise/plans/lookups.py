"""Route and stop lookup marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gtfs_routes(staged_routes: DataFrame) -> DataFrame:
    return staged_routes.select("route_id", "route_name", "route_long_name", "route_type")


def gtfs_stops(staged_stops: DataFrame) -> DataFrame:
    return staged_stops.select(
        "stop_id",
        "stop_name",
        F.col("stop_lat").alias("lat"),
        F.col("stop_lon").alias("lon"),
    )


def stop_list(staged_stops: DataFrame) -> DataFrame:
    return staged_stops.select("stop_id", "stop_name", "stop_lat", "stop_lon")
