"""Transit inputs derived from the given tables.

Each view is one SELECT in the SQL that Spark and DuckDB share, so both sides start from the same
rows. Positions follow a Z-order curve of the key: the covered area grows with the table while
its density stays the same.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.params import Params
from stopwise.session import tune

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}
TABLES = (
    *SCHEMAS, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"
)

AS_OF = datetime(2024, 1, 31, 12, tzinfo=UTC)
PARAMS = Params(as_of=AS_OF)
EXTRACT = "DATE '2024-01-05'"


def _z(key: str, odd: bool) -> str:
    """Even (x) or odd (y) bits of a key, closed up."""
    terms = [f"((({key}) >> {2 * i + odd}) & 1) * {1 << i}" for i in range(16)]
    return "(" + " + ".join(terms) + ")"


def _position(key: str, spacing: int, jitter: str = "0") -> tuple[str, str]:
    """Longitude and latitude in whole 1e-5 degrees."""
    return (
        f"({_z(key, False)} * {spacing} + {jitter} - 10520000)",
        f"({_z(key, True)} * {spacing} + {jitter} + 3960000)",
    )


def _degrees(units: str) -> str:
    return f"(CAST({units} AS DOUBLE) / 100000)"


STOP_LON, STOP_LAT = _position("p_partkey", 150)
CRASH_LON, CRASH_LAT = _position("o_orderkey >> 1", 78, "(o_orderkey >> 1) * 37 % 40")
TRACT_LON, TRACT_LAT = _position("c_custkey", 170)
ROUTE = "CAST(floor({key} / 15) AS BIGINT)"
# Fixed rows of a stop pattern; spelled per dialect in FANOUT.
FANOUT = {
    "spark": "LATERAL VIEW explode(array(0, 1, 2, 3, 4)) steps AS i",
    "duckdb": "CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS steps(i)",
}


def _stop_of(trip: str, step: str) -> str:
    return f"concat('S', {ROUTE.format(key=trip)} * 3 + ({trip} * 7 + {step}) % 3)"


def _ring(west: str, south: str, east: str, north: str) -> str:
    corners = ((west, south), (east, south), (east, north), (west, north), (west, south))
    text = ", ',', ".join(f"'[', {x}, 'e-5,', {y}, 'e-5]'" for x, y in corners)
    return f"'[', {text}, ']'"


def _tract_geojson() -> str:
    """Square tract; every fourth has a square hole."""
    outer = _ring("x", "y", "(x + 160)", "(y + 160)")
    inner = _ring("(x + 40)", "(y + 40)", "(x + 120)", "(y + 120)")
    # Doubled braces survive the filling-in of table names.
    head, tail = "'{{\"type\":\"Polygon\",\"coordinates\":['", "']}}'"
    return (
        f"CASE WHEN c_custkey % 4 = 0 THEN concat({head}, {outer}, ',', {inner}, {tail}) "
        f"ELSE concat({head}, {outer}, {tail}) END"
    )


VIEWS: dict[str, str] = {
    "v_updates": f"""
        SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS feed_ts_utc,
               concat('E', event_id) AS entity_id,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('T', user_id) END AS trip_id,
               concat('R', {ROUTE.format(key='user_id')}) AS route_id,
               {_stop_of('user_id', 'event_id')} AS stop_id,
               event_id % 6 AS stop_sequence,
               CASE WHEN event_type <> 'error' AND event_id % 3 <> 0
                    THEN CAST(floor(value * 8) AS BIGINT) - 200 END AS arrival_delay_sec,
               CASE WHEN event_type <> 'error' AND event_id % 2 = 0
                    THEN CAST(floor(value * 8) AS BIGINT) - 170 END AS departure_delay_sec,
               CASE WHEN event_type = 'view' THEN 'SKIPPED' ELSE 'SCHEDULED' END
                   AS schedule_relationship,
               CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', CAST(ts AS TIMESTAMP)) END
                   AS event_ts_utc
        FROM {{events}} WHERE event_type IN ('click', 'view', 'error')""",
    "v_positions": f"""
        SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS feed_ts_utc,
               concat('V', event_id) AS entity_id,
               CASE WHEN event_id % 50 = 1 THEN NULL ELSE concat('T', user_id) END AS trip_id,
               concat('R', {ROUTE.format(key='user_id')}) AS route_id,
               concat('B', user_id % 50) AS vehicle_id,
               concat('Bus ', event_id % 9) AS vehicle_label,
               CAST(user_id % 90 AS DOUBLE) / 100 - 105.2 AS lon,
               CAST(event_id % 60 AS DOUBLE) / 100 + 39.5 AS lat,
               CAST(event_id % 360 AS DOUBLE) AS bearing,
               value AS speed_mps,
               CASE WHEN event_id % 13 <> 0 THEN date_trunc('second', CAST(ts AS TIMESTAMP)) END
                   AS event_ts_utc
        FROM {{events}} WHERE event_type IN ('signup', 'purchase')""",
    "v_calendar": f"""
        SELECT concat('W', n_nationkey) AS service_id,
               CASE WHEN n_nationkey % 3 <> 0 THEN 1 ELSE 0 END AS monday,
               CASE WHEN n_nationkey % 4 <> 0 THEN 1 ELSE 0 END AS tuesday,
               1 AS wednesday,
               CASE WHEN n_nationkey % 5 <> 0 THEN 1 ELSE 0 END AS thursday,
               1 AS friday,
               n_nationkey % 2 AS saturday,
               CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS sunday,
               CASE WHEN n_nationkey = 24 THEN ''
                    ELSE concat('202401', lpad(CAST(1 + n_nationkey % 5 AS STRING), 2, '0')) END
                   AS start_date,
               concat('202401', CAST(20 + n_nationkey % 13 AS STRING)) AS end_date,
               CASE WHEN n_nationkey % 7 = 6 THEN DATE '2024-01-01' ELSE {EXTRACT} END
                   AS _extract_date
        FROM {{nation}}""",
    "v_calendar_dates": f"""
        SELECT concat('W', n_nationkey) AS service_id,
               concat('202401', CAST(10 + n_nationkey % 15 AS STRING)) AS date,
               1 + n_nationkey % 2 AS exception_type,
               {EXTRACT} AS _extract_date
        FROM {{nation}}""",
    "v_trips": f"""
        SELECT concat('R', {ROUTE.format(key='c_custkey')}) AS route_id,
               concat('W', c_nationkey) AS service_id,
               concat('T', c_custkey) AS trip_id,
               c_mktsegment AS trip_headsign,
               CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 2 END AS direction_id,
               concat('H', c_custkey % 100) AS shape_id,
               {EXTRACT} AS _extract_date
        FROM {{customer}}""",
    "v_stop_times": f"""
        SELECT concat('T', c_custkey) AS trip_id,
               CASE WHEN (c_custkey + i) % 19 = 0 THEN ''
                    ELSE concat(lpad(CAST(5 + (c_custkey * 3 + i) % 22 AS STRING), 2, '0'), ':',
                                lpad(CAST((c_custkey * 13 + i * 7) % 60 AS STRING), 2, '0'),
                                ':00') END AS arrival_time,
               CASE WHEN (c_custkey + i) % 23 = 0 THEN NULL
                    ELSE concat(lpad(CAST(5 + (c_custkey * 3 + i) % 22 AS STRING), 2, '0'), ':',
                                lpad(CAST((c_custkey * 13 + i * 7) % 60 AS STRING), 2, '0'),
                                ':30') END AS departure_time,
               {_stop_of('c_custkey', 'i')} AS stop_id,
               CAST(i AS BIGINT) AS stop_sequence,
               {EXTRACT} AS _extract_date
        FROM {{customer}} {{fanout}}""",
    "v_weather": """
        SELECT date, station, precip_mm, snow_day,
               CASE WHEN precip_mm <= 0 THEN 'none' WHEN precip_mm <= 5 THEN 'light'
                    WHEN precip_mm <= 20 THEN 'mod' WHEN precip_mm > 20 THEN 'heavy' END
                   AS precip_bin
        FROM (SELECT date, station, snow_day,
                     CASE WHEN n % 9 <> 0 THEN CAST(n * 7 % 25 AS DOUBLE) END AS precip_mm
              FROM (SELECT CAST(ts AS DATE) AS date,
                           CASE user_id % 3 WHEN 0 THEN 'USW00023062'
                                WHEN 1 THEN 'USC00000001' ELSE 'USC00000002' END AS station,
                           CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
                                AS BIGINT) AS n,
                           CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
                                AS BIGINT) % 2 AS snow_day
                    FROM {events} GROUP BY 1, 2) AS days) AS measured""",
    "v_stops": f"""
        SELECT concat('S', p_partkey) AS stop_id,
               p_name AS stop_name,
               {_degrees("y")} AS stop_lat,
               {_degrees("x")} AS stop_lon,
               CAST(p_size % 3 AS STRING) AS wheelchair_boarding
        FROM (SELECT *, {STOP_LON} AS x, {STOP_LAT} AS y FROM {{part}}) AS placed""",
    "v_routes": """
        SELECT concat('R', s_suppkey) AS route_id,
               CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('Line ', s_suppkey) END
                   AS route_short_name,
               s_name AS route_long_name,
               CASE WHEN s_nationkey % 2 = 0 THEN 'local' END AS route_desc,
               CASE WHEN s_suppkey % 5 = 0 THEN 'LX2' ELSE '3' END AS route_type
        FROM {supplier}""",
    "v_crashes": f"""
        SELECT concat('C', o_orderkey) AS crash_id,
               CAST(o_orderdate AS TIMESTAMP) AS event_ts_utc,
               CAST(CASE WHEN substring(o_orderpriority, 1, 1) = '5' THEN 4
                         ELSE CAST(substring(o_orderpriority, 1, 1) AS INT) END AS BIGINT)
                   AS severity,
               o_orderpriority AS severity_text,
               {_degrees("x")} AS lon,
               {_degrees("y")} AS lat,
               concat('Road ', o_custkey % 500) AS roadway_name,
               CAST(NULL AS STRING) AS on_route,
               CAST(NULL AS STRING) AS off_route,
               CAST(o_orderkey % 2 AS BIGINT) AS bike_involved,
               CAST(o_orderkey % 3 AS BIGINT) AS ped_involved
        FROM (SELECT *, {CRASH_LON} AS x, {CRASH_LAT} AS y FROM {{orders}}) AS placed""",
    "v_sidewalks": f"""
        SELECT concat('K', p_partkey) AS sidewalk_id,
               p_type AS class, p_brand AS status, 'concrete' AS material,
               CAST(1950 + p_size AS STRING) AS year_built,
               {_degrees("(x + p_partkey % 7 * 30)")} AS lon_start,
               {_degrees("(y - p_partkey % 11 * 20)")} AS lat_start,
               {_degrees("(x + p_partkey % 7 * 30 + p_partkey % 5 * 90)")} AS lon_end,
               {_degrees("(y - p_partkey % 11 * 20 + p_partkey % 3 * 70)")} AS lat_end,
               CAST(p_size AS DOUBLE) AS length_m,
               {_degrees("x")} AS centroid_lon,
               {_degrees("y")} AS centroid_lat,
               {EXTRACT} AS _extract_date
        FROM (SELECT *, {STOP_LON} AS x, {STOP_LAT} AS y FROM {{part}}) AS placed""",
    "v_tracts": f"""
        SELECT concat('08031', lpad(CAST(c_custkey AS STRING), 9, '0')) AS geoid,
               c_name AS name,
               CAST(c_custkey AS DOUBLE) AS aland_m2,
               0.0e0 AS awater_m2,
               {_tract_geojson()} AS geometry_geojson,
               TIMESTAMP '2024-01-05 00:00:00' AS _ingested_at
        FROM (SELECT *, {TRACT_LON} AS x, {TRACT_LAT} AS y FROM {{customer}}) AS placed""",
    "v_acs": """
        SELECT concat('14000US08031', lpad(CAST(c_custkey AS STRING), 9, '0')) AS geoid,
               c_name AS name,
               2023 AS year,
               CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 0 END
                   AS pop_total,
               CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) / 100 END
                   AS pct_hh_no_vehicle,
               CAST(c_custkey * 7 % 100 AS DOUBLE) / 100 AS pct_transit_commute,
               CAST(c_custkey * 13 % 100 AS DOUBLE) / 100 AS pct_poverty,
               TIMESTAMP '2024-01-05 00:00:00' AS _ingested_at
        FROM {customer}""",
}


def duckdb_view(name: str) -> str:
    """A view as DuckDB text over the registered tables."""
    text = VIEWS[name].replace("{fanout}", FANOUT["duckdb"])
    text = re.sub(r"\{(\w+)\}", r"\1", text)
    return text.replace("{{", "{").replace("}}", "}")


class Inputs:
    """Lazy access to the given tables and the views over them."""

    params = PARAMS

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self.frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; the declared schema spares the job that would infer it."""
        if name not in self.frames:
            path = f"{self.sf_dir}/{name}.parquet"
            self.frames[name] = self.spark.read.schema(SCHEMAS[name]).parquet(path)
        return self.frames[name]

    def view(self, name: str) -> DataFrame:
        if name not in self.frames:
            text = VIEWS[name].replace("{fanout}", FANOUT["spark"])
            used = {n: self.table(n) for n in SCHEMAS if "{" + n + "}" in text}
            self.frames[name] = self.spark.sql(text, **used)
        return self.frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") and name in VIEWS:
            return self.view(name)
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)


#: Days that a spine goes on at either end of what its table has.
AROUND = 7


def range_of(rows: DataFrame, column: str) -> tuple[date, date]:
    """First and last date of a column with some days around, by one aggregate of one row."""
    first, last = rows.agg(
        F.date_sub(F.min(F.to_date(column)), AROUND), F.date_add(F.max(F.to_date(column)), AROUND)
    ).first()
    if first is None:
        raise ValueError(f"{column} has no date")
    return first, last


def range_sql(table: str, column: str) -> str:
    """SQL: the dates of ``range_of`` as rows of ``day``."""
    return (
        f"SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day FROM "
        f"(SELECT CAST(min({column}) AS DATE) - {AROUND} AS first, CAST(max({column}) AS DATE) + {AROUND} AS last "
        f"FROM {table}) AS ends"
    )
