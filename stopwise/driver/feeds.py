"""Queries of the feed normalizers over records landed from the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from stopwise.driver.catalog import register
from stopwise.driver.model import Model
from stopwise.driver.views import range_of, range_sql
from stopwise.functions import geo
from stopwise.functions.clock import local_date, local_hour, service_instant, service_seconds
from stopwise.functions.safe import flag
from stopwise.sources import acs, crashes, gtfs, realtime, sidewalks, tracts, weather

# -- realtime ---------------------------------------------------------------------------


def _trip_feed(m: Model):
    """One landed snapshot entity per order, its line items as stop-time updates."""
    lines = m.inputs.lineitem.selectExpr(
        "l_orderkey",
        "date_trunc('day', cast(l_shipdate as timestamp)) as shipped",
        """struct(if(l_suppkey % 9 = 0, '', concat('S', l_suppkey)) as stop_id,
                  cast(l_linenumber as bigint) as stop_sequence,
                  if(l_partkey % 3 = 0, null, struct(
                      cast(l_extendedprice - 30000 as bigint) as delay,
                      if(l_partkey % 2 = 0, unix_seconds(cast(l_shipdate as timestamp)), null)
                          as time)) as arrival,
                  if(l_partkey % 4 = 0, null, struct(
                      cast(l_quantity as bigint) as delay,
                      if(l_partkey % 5 = 0, unix_seconds(cast(l_shipdate as timestamp)) + 60,
                         null) as time)) as departure) as update""",
    )
    trips = lines.groupBy("l_orderkey").agg(F.collect_list("update").alias("updates"))
    return trips.selectExpr(
        "timestamp_seconds(l_orderkey * 61) as captured_at",
        """array(struct(concat('E', l_orderkey) as id, struct(
               struct(concat('T', l_orderkey) as trip_id,
                      if(l_orderkey % 7 = 0, '', concat('R', l_orderkey % 5)) as route_id,
                      cast(null as string) as start_date, '' as start_time,
                      cast(null as string) as schedule_relationship) as trip,
               if(l_orderkey % 2 = 0, 0L, 1700000000L + l_orderkey) as timestamp,
               updates as stop_time_update) as trip_update)) as entity""",
    )


FLAT_UPDATES = """
    SELECT to_timestamp(l_orderkey * 61 // 60 * 60)::TIMESTAMP AS feed_ts_utc,
           concat('E', l_orderkey) AS entity_id, concat('T', l_orderkey) AS trip_id,
           CASE WHEN l_orderkey % 7 <> 0 THEN concat('R', l_orderkey % 5) END AS route_id,
           CASE WHEN l_suppkey % 9 <> 0 THEN concat('S', l_suppkey) END AS stop_id,
           l_linenumber AS stop_sequence,
           CASE WHEN l_partkey % 3 <> 0 THEN CAST(trunc(l_extendedprice - 30000) AS BIGINT) END
               AS arrival_delay_sec,
           CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_quantity AS BIGINT) END
               AS departure_delay_sec,
           'SCHEDULED' AS schedule_relationship,
           CASE WHEN l_partkey % 3 <> 0 AND l_partkey % 2 = 0 THEN l_shipdate
                WHEN l_partkey % 4 <> 0 AND l_partkey % 5 = 0 THEN l_shipdate + INTERVAL 1 MINUTE
                WHEN l_orderkey % 2 <> 0 THEN to_timestamp(1700000000 + l_orderkey)::TIMESTAMP
                ELSE to_timestamp(l_orderkey * 61 // 60 * 60)::TIMESTAMP END AS event_ts_utc
    FROM lineitem"""


@register(
    "trip_update_flatten",
    "feed_ts_utc:t entity_id:s trip_id:s route_id:s stop_id:s stop_sequence:i "
    "arrival_delay_sec:i departure_delay_sec:i schedule_relationship:s event_ts_utc:t",
    FLAT_UPDATES,
)
def _trip_update_flatten(m: Model):
    return realtime.trip_updates(_trip_feed(m))


@register(
    "trip_update_route_filter",
    "entity_id:s route_id:s stop_sequence:i",
    f"SELECT * FROM ({FLAT_UPDATES}) AS u WHERE route_id IN ('R1', 'R3')",
)
def _trip_update_route_filter(m: Model):
    return realtime.trip_updates(_trip_feed(m), "R1, R3,")


@register(
    "delay_outliers",
    "delay_outlier_count:i",
    f"""SELECT count(*) FILTER (arrival_delay_sec NOT BETWEEN -3600 AND 7200)
             + count(*) FILTER (departure_delay_sec NOT BETWEEN -3600 AND 7200)
               AS delay_outlier_count
        FROM ({FLAT_UPDATES}) AS u""",
)
def _delay_outliers(m: Model):
    return realtime.delay_outliers(realtime.trip_updates(_trip_feed(m)))


def _vehicle_feed(m: Model):
    return m.inputs.events.selectExpr(
        "cast(ts as timestamp) as captured_at",
        """array(struct(concat('V', event_id) as id, struct(
               struct(concat('T', user_id) as trip_id, '' as route_id) as trip,
               struct(if(user_id % 6 = 0, '', concat('B', user_id)) as id,
                      event_type as label) as vehicle,
               if(event_id % 4 = 0, null, struct(
                   -105.6D + cast(event_id % 130 as double) / 100 as longitude,
                   39.3D + cast(user_id % 100 as double) / 100 as latitude,
                   cast(null as double) as bearing, value as speed)) as position,
               if(event_id % 5 = 0, null, 1700000000L + event_id) as timestamp) as vehicle))
           as entity""",
    )


FLAT_POSITIONS = """
    SELECT date_trunc('minute', ts) AS feed_ts_utc, concat('V', event_id) AS entity_id,
           concat('T', user_id) AS trip_id, CAST(NULL AS VARCHAR) AS route_id,
           CASE WHEN user_id % 6 <> 0 THEN concat('B', user_id) END AS vehicle_id,
           event_type AS vehicle_label,
           CASE WHEN event_id % 4 <> 0
                THEN -105.6::DOUBLE + CAST(event_id % 130 AS DOUBLE) / 100 END AS lon,
           CASE WHEN event_id % 4 <> 0
                THEN 39.3::DOUBLE + CAST(user_id % 100 AS DOUBLE) / 100 END AS lat,
           CASE WHEN event_id % 4 <> 0 THEN value END AS speed_mps,
           CASE WHEN event_id % 5 <> 0 THEN to_timestamp(1700000000 + event_id)::TIMESTAMP
                ELSE date_trunc('minute', ts) END AS event_ts_utc
    FROM events"""


@register(
    "vehicle_position_flatten",
    "feed_ts_utc:t entity_id:s trip_id:s route_id:s vehicle_id:s vehicle_label:s lon:f lat:f "
    "speed_mps:f event_ts_utc:t",
    FLAT_POSITIONS,
)
def _vehicle_position_flatten(m: Model):
    return realtime.vehicle_positions(_vehicle_feed(m))


INSIDE = "lon BETWEEN -105.5 AND -104.4 AND lat BETWEEN 39.4 AND 40.2"


@register(
    "position_quality",
    "in_bbox_pct:f out_of_bbox_count:i",
    f"""SELECT count(*) FILTER ({INSIDE}) * 100.0 / count(*) AS in_bbox_pct,
               count(*) FILTER (NOT ({INSIDE})) AS out_of_bbox_count
        FROM ({FLAT_POSITIONS}) AS p WHERE lon IS NOT NULL""",
)
def _position_quality(m: Model):
    return realtime.position_quality(realtime.vehicle_positions(_vehicle_feed(m)))


# -- crashes ----------------------------------------------------------------------------


def _crash_features(m: Model):
    return m.inputs.orders.selectExpr(
        """struct(concat('X', o_orderkey) as incident_id,
            case when o_orderkey % 20 = 0 then 'soon' when o_orderkey % 21 = 0 then null
                 else cast(unix_millis(cast(o_orderdate as timestamp)) + 999 as string) end
                as first_occurrence_date,
            case o_custkey % 5 when 0 then ' ACCIDENT - SBI ' when 1 then 'Injury'
                 when 2 then 'FATAL' when 3 then null else 'hit and run' end
                as top_traffic_accident_offense,
            case o_orderkey % 6 when 0 then ' E Colfax Ave / N Broadway '
                 when 1 then 'W 6th Ave & I25 & Ramp' when 2 then '1200 Blake St'
                 when 3 then '' when 4 then null else 'A & B / C' end as incident_address,
            if(o_orderkey % 4 = 0, null, cast(39.3D + cast(o_orderkey % 90 as double) / 100 as string))
                as geo_lat,
            if(o_orderkey % 5 = 0, null, '-104.9') as geo_lon,
            if(o_orderkey % 3 = 0, null, '-105.1') as POINT_X,
            if(o_orderkey % 7 = 0, null, '39.9') as POINT_Y,
            case o_orderkey % 5 when 0 then null when 1 then 'Yes' when 2 then '2'
                 when 3 then '0' else 'nope' end as bicycle_ind,
            if(o_orderkey % 2 = 0, 't', '') as pedestrian_ind,
            if(o_custkey % 11 = 0, '1', '0') as SERIOUSLY_INJURED,
            if(o_custkey % 13 = 0, '2', null) as FATALITIES) as attributes""",
        """if(o_orderkey % 2 = 0, null, struct(-11675000D + o_orderkey % 1000 as x,
              4825000D + o_orderkey % 777 as y)) as geometry""",
    )


CRASH_SQL = """
    SELECT *, coalesce(lat IS NULL, true) AND roadway_name IS NULL AS unplaced FROM (
        SELECT concat('X', o_orderkey) AS crash_id, o_orderkey,
               CASE WHEN o_orderkey % 20 <> 0 AND o_orderkey % 21 <> 0
                    THEN CAST(o_orderdate AS TIMESTAMP) END AS event_ts_utc,
               CASE WHEN o_custkey % 13 = 0 THEN 4 WHEN o_custkey % 11 = 0 THEN 3
                    ELSE [3, 2, 4, 1, 1][o_custkey % 5 + 1] END AS severity,
               CASE WHEN o_custkey % 13 = 0 THEN 'fatal'
                    WHEN o_custkey % 11 = 0 THEN 'serious_injury'
                    ELSE ['serious_injury', 'injury', 'fatal', 'property_damage',
                          'property_damage'][o_custkey % 5 + 1] END AS severity_text,
               ['E Colfax Ave / N Broadway', 'W 6th Ave & I25 & Ramp', '1200 Blake St', NULL,
                NULL, 'A & B / C'][o_orderkey % 6 + 1] AS roadway_name,
               ['E Colfax Ave', 'W 6th Ave', '1200 Blake St', NULL, NULL,
                'A & B'][o_orderkey % 6 + 1] AS on_route,
               ['N Broadway', 'I25 & Ramp', NULL, NULL, NULL, 'C'][o_orderkey % 6 + 1]
                   AS off_route,
               CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0
                         THEN 39.3::DOUBLE + CAST(o_orderkey % 90 AS DOUBLE) / 100
                    WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN 39.9
                    WHEN o_orderkey % 2 <> 0
                         THEN degrees(2 * atan(exp((4825000 + o_orderkey % 777) / 6378137.0))
                                      - pi() / 2) END AS lat,
               CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN -104.9
                    WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN -105.1
                    WHEN o_orderkey % 2 <> 0
                         THEN degrees((-11675000 + o_orderkey % 1000) / 6378137.0) END AS lon,
               [0, 1, 1, 0, 0][o_orderkey % 5 + 1] AS bike_involved,
               CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS ped_involved
        FROM orders) AS c"""


@register(
    "crash_severity",
    "crash_id:s event_ts_utc:t severity:i severity_text:s bike_involved:i ped_involved:i",
    f"SELECT * FROM ({CRASH_SQL}) AS x",
)
def _crash_severity(m: Model):
    return crashes.crash_rows(_crash_features(m))


@register(
    "address_split",
    "crash_id:s roadway_name:s on_route:s off_route:s",
    f"SELECT * FROM ({CRASH_SQL}) AS x",
)
def _address_split(m: Model):
    return crashes.crash_rows(_crash_features(m))


@register(
    "coord_resolve",
    "crash_id:s lat:f lon:f roadway_name:s",
    f"SELECT * FROM ({CRASH_SQL}) AS x WHERE NOT unplaced",
)
def _coord_resolve(m: Model):
    return crashes.crashes(_crash_features(m))


@register(
    "crash_quality",
    "total:i dropped_no_location:i timestamp_success:i timestamp_failures:i bbox_total:i "
    "bbox_in:i timestamp_success_pct:f bbox_in_pct:f",
    f"""WITH s AS (
            SELECT count(*) AS total, count(*) FILTER (unplaced) AS dropped_no_location,
                   count(event_ts_utc) AS timestamp_success,
                   count(*) - count(event_ts_utc) AS timestamp_failures,
                   count(lat) AS bbox_total,
                   count(*) FILTER (lon BETWEEN -105.2 AND -104.5 AND lat BETWEEN 39.4 AND 40.2)
                       AS bbox_in
            FROM ({CRASH_SQL}) AS x)
        SELECT *, timestamp_success * 100.0 / (total - dropped_no_location)
                      AS timestamp_success_pct, bbox_in * 100.0 / bbox_total AS bbox_in_pct
        FROM s""",
)
def _crash_quality(m: Model):
    return crashes.crash_quality(_crash_features(m))


@register(
    "flag_coercion",
    "o_orderpriority:s n:i set:i",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_custkey % 4 IN (1, 2)) AS set
       FROM orders GROUP BY o_orderpriority""",
)
def _flag_coercion(m: Model):
    value = F.expr("element_at(array('', 'TRUE', '-3', 'no'), cast(o_custkey % 4 as int) + 1)")
    return (
        m.inputs.orders.withColumn("f", flag(value))
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("set"))
    )


# -- sidewalks and tracts ---------------------------------------------------------------


def _sidewalk_features(m: Model):
    """One feature per order; its line items are the vertices of one path."""
    paths = m.inputs.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(
                F.expr(
                    "array(-105D + cast(l_linenumber as double) / 1000, "
                    "39.7D + cast(l_suppkey as double) / 10000)"
                )
            )
        ).alias("path")
    )
    return paths.selectExpr(
        "l_orderkey",
        """struct(cast(l_orderkey as string) as OBJECTID,
                  if(l_orderkey % 3 = 0, '', concat(' F', l_orderkey, ' ')) as FACILITYID,
                  'Detached' as SIDEWALKTYPE, cast(null as string) as SIDEWALKSTATUS,
                  ' Brick' as SURFACE, if(l_orderkey % 2 = 0, '1987', 'n/a') as BUILTYEAR)
           as attributes""",
        "struct(array(path) as paths) as geometry",
    )


@register(
    "sidewalk_flatten",
    "sidewalk_id:s class:s status:s material:s year_built:s lon_start:p lat_start:p lon_end:p "
    "lat_end:p centroid_lon:p centroid_lat:p",
    """SELECT CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_orderkey AS VARCHAR)
                   ELSE concat('f', l_orderkey) END AS sidewalk_id,
              'detached' AS class, '' AS status, 'brick' AS material,
              CASE WHEN l_orderkey % 2 = 0 THEN '1987' END AS year_built,
              min(v)[1] AS lon_start, min(v)[2] AS lat_start, max(v)[1] AS lon_end,
              max(v)[2] AS lat_end, avg(v[1]) AS centroid_lon, avg(v[2]) AS centroid_lat
       FROM (SELECT l_orderkey, [-105::DOUBLE + CAST(l_linenumber AS DOUBLE) / 1000,
                                 39.7::DOUBLE + CAST(l_suppkey AS DOUBLE) / 10000] AS v
             FROM lineitem) AS p GROUP BY l_orderkey""",
)
def _sidewalk_flatten(m: Model):
    return sidewalks.sidewalks(_sidewalk_features(m))


def _krueger_sql() -> tuple[str, str]:
    """Easting and northing of lon, lat as SQL, by the series of the projection's definition."""
    f = geo.GRS80_F
    n = f / (2 - f)
    radius = geo.UTM_SCALE * geo.GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    east = " + ".join(
        ["eta"] + [f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)"
                   for j, a in enumerate(terms, 1)]
    )
    north = " + ".join(
        ["xi"] + [f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)"
                  for j, a in enumerate(terms, 1)]
    )
    return f"({east}) * {radius!r}::DOUBLE", f"({north}) * {radius!r}::DOUBLE"


EAST, NORTH = _krueger_sql()
ECCENTRICITY = repr((geo.GRS80_F * (2 - geo.GRS80_F)) ** 0.5) + "::DOUBLE"


@register(
    "sidewalk_network",
    "segment_count:i positive_length_pct:f total_length_km:f",
    f"""WITH v AS (
            SELECT l_orderkey, -105::DOUBLE + CAST(l_linenumber AS DOUBLE) / 1000 AS lon,
                   39.7::DOUBLE + CAST(l_suppkey AS DOUBLE) / 10000 AS lat FROM lineitem),
        c AS (SELECT *, radians(lon + 105) AS lam,
                     sinh(atanh(sin(radians(lat)))
                          - {ECCENTRICITY} * atanh({ECCENTRICITY} * sin(radians(lat)))) AS t
              FROM v),
        g AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM c),
        p AS (SELECT l_orderkey, lon, lat, {EAST} AS e, {NORTH} AS n FROM g),
        s AS (SELECT l_orderkey, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)) AS m
              FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY lon, lat)),
        o AS (SELECT l_orderkey, coalesce(sum(m), 0) AS m FROM s GROUP BY l_orderkey)
        SELECT count(*) AS segment_count,
               count(*) FILTER (m > 0) * 100.0 / count(*) AS positive_length_pct,
               sum(m) / 1000 AS total_length_km FROM o""",
)
def _sidewalk_network(m: Model):
    features = _sidewalk_features(m)
    return sidewalks.network_quality(features, sidewalks.sidewalks(features))


def _tract_features(m: Model):
    """A square per customer, some turned the wrong way, some with a hole or a short ring."""
    ring = "array(array(x, y), array(x, y + {s}), array(x + {s}, y + {s}), array(x + {s}, y), array(x, y))"
    return m.inputs.customer.selectExpr(
        "*", "cast(c_custkey % 100 as double) as x", "cast(c_custkey div 100 as double) as y"
    ).selectExpr(
        """map(if(c_custkey % 2 = 0, 'GEOID20', 'GEOID'), concat('08031', c_custkey),
               'NAMELSAD', if(c_custkey % 5 = 0, '', c_name),
               'ALAND20', cast(c_custkey as string),
               'COUNTYFP20', if(c_nationkey % 2 = 0, '031', '001'), 'STATEFP20', '08')
           as attributes""",
        f"""struct(case c_custkey % 4
             when 0 then array({ring.format(s='4D')}, reverse({ring.format(s='1D')}))
             when 1 then array(reverse({ring.format(s='4D')}))
             when 2 then array(array(array(x, y), array(x, y + 1), array(x, y)))
             else array({ring.format(s='4D')}, {ring.format(s='2D')}) end as rings) as geometry""",
    )


@register(
    "tract_normalize",
    "geoid:s name:s aland_m2:f kind:s n_points:i",
    """SELECT concat('08031', c_custkey) AS geoid,
              CASE WHEN c_custkey % 5 = 0 THEN concat('08031', c_custkey) ELSE c_name END AS name,
              c_custkey AS aland_m2,
              CASE WHEN c_custkey % 4 = 3 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
              CASE WHEN c_custkey % 4 = 1 THEN 5 ELSE 10 END AS n_points
       FROM customer WHERE c_custkey % 4 <> 2 AND c_nationkey % 2 = 0""",
)
def _tract_normalize(m: Model):
    rows = tracts.tracts(tracts.county_features(_tract_features(m)))
    points = "size(regexp_extract_all(geometry_geojson, '[0-9.]+,[0-9.]+', 0))"
    return rows.withColumns(
        {
            "kind": F.get_json_object("geometry_geojson", "$.type"),
            "n_points": F.expr(points),
        }
    )


@register(
    "tract_quality",
    "total:i missing_geometry:i",
    """SELECT count(*) FILTER (c_custkey % 4 <> 2) AS total,
              count(*) FILTER (c_custkey % 4 = 2) AS missing_geometry FROM customer""",
)
def _tract_quality(m: Model):
    return tracts.tract_quality(_tract_features(m))


# -- weather and demographics -----------------------------------------------------------


def last(value: str, where: str) -> str:
    """The value of the greatest order key, the greatest one on a tie."""
    return f"(list({value} ORDER BY l_orderkey DESC, {value} DESC) FILTER ({where}))[1]"


WEATHER_WIDE = f"""
    SELECT CAST(l_shipdate AS DATE) AS date, 'W1' AS station,
           {last('l_quantity * 9', 'l_linenumber = 1')} AS snow,
           {last('l_quantity', 'l_linenumber = 2')} AS prcp,
           {last('-l_quantity', 'l_linenumber = 3')} AS tmin,
           {last('l_discount * 100', 'l_linenumber = 4')} AS tmax,
           {last('l_quantity * 3', 'l_linenumber = 5 AND l_suppkey % 2 = 0')} AS tavg
    FROM lineitem GROUP BY 1, 2"""
WEATHER_SQL = f"""
    WITH w AS ({WEATHER_WIDE}),
    d AS (SELECT day AS date FROM ({range_sql('lineitem', 'l_shipdate')}) AS t),
    s AS (SELECT d.date, coalesce(station, 'USW00023062') AS station,
                 CASE WHEN max(snow) OVER () >= 200 THEN snow * 0.1::DOUBLE ELSE snow END AS snow,
                 prcp, tmin, tmax,
                 CASE WHEN max(tavg) OVER () >= 100 THEN tavg * 0.1::DOUBLE ELSE tavg END AS tavg
          FROM d LEFT JOIN w ON w.date = d.date)
    SELECT date, station, round(snow, 2) AS snow_mm, round(prcp, 2) AS precip_mm,
           round(tmin, 2) AS tmin_c, round(tmax, 2) AS tmax_c,
           round(coalesce(tavg, (tmin + tmax) / 2), 2) AS tavg_c,
           CASE WHEN snow >= 1 THEN 1 WHEN snow < 1 THEN 0 END AS snow_day,
           CASE WHEN prcp <= 0 THEN 'none' WHEN prcp <= 5 THEN 'light' WHEN prcp <= 20 THEN 'mod'
                WHEN prcp > 20 THEN 'heavy' END AS precip_bin
    FROM s"""


def _observations(m: Model):
    kind = "element_at(array('SNOW', 'PRCP', 'TMIN', 'TMAX', 'TAVG', 'WIND', 'WIND'), l_linenumber)"
    return m.inputs.lineitem.selectExpr(
        "concat(cast(cast(l_shipdate as date) as string), 'T00:00:00') as date",
        "'W1' as station",
        "l_orderkey as loaded",
        f"{kind} as datatype",
        """case l_linenumber when 1 then l_quantity * 9 when 3 then -l_quantity
                when 4 then l_discount * 100
                when 5 then if(l_suppkey % 2 = 0, l_quantity * 3, null)
                else l_quantity end as value""",
    )


def _days(m: Model):
    """Every day from before the first observation to after the last one."""
    first, last = range_of(m.inputs.lineitem, "l_shipdate")
    return weather.daily_weather(weather.widen(_observations(m), "loaded"), first, last)


@register(
    "weather_pivot_spine",
    "date:d station:s snow_mm:f precip_mm:f tmin_c:f tmax_c:f tavg_c:f snow_day:i precip_bin:s",
    WEATHER_SQL,
)
def _weather_pivot_spine(m: Model):
    return _days(m)


@register(
    "unit_scale",
    "date:d snow_mm:f tavg_c:f",
    f"""WITH w AS ({WEATHER_WIDE})
        SELECT date, CASE WHEN max(snow) OVER () >= 200 THEN snow * 0.1::DOUBLE ELSE snow END
                         AS snow_mm,
               CASE WHEN max(tavg) OVER () >= 100 THEN tavg * 0.1::DOUBLE ELSE tavg END AS tavg_c
        FROM w""",
)
def _unit_scale(m: Model):
    return weather.scale_units(weather.widen(_observations(m), "loaded"))


@register(
    "weather_local_csv",
    "date:d station:s snow_mm:f precip_mm:f",
    """SELECT CAST(o_orderdate AS DATE) AS date, concat('W', o_custkey % 3) AS station,
              o_totalprice AS snow_mm, NULL AS precip_mm
       FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'""",
)
def _weather_local_csv(m: Model):
    rows = m.inputs.orders.selectExpr(
        "concat(cast(o_orderdate as date), ' 00:00') as DATE",
        "concat('W', o_custkey % 3) as STATION",
        "cast(o_totalprice as string) as SNOW",
        "'NA' as PRCP", "'' as TMIN", "'' as TMAX", "'' as TAVG",
    )
    return weather.from_local_csv(rows, date(1998, 1, 1), date(1998, 12, 31))


@register(
    "precip_bins",
    "precip_bin:s n:i total:f",
    """SELECT CASE WHEN q <= 0 THEN 'none' WHEN q <= 5 THEN 'light' WHEN q <= 20 THEN 'mod'
                   WHEN q > 20 THEN 'heavy' END AS precip_bin, count(*) AS n, sum(q) AS total
       FROM (SELECT nullif(l_quantity - 3, 1) AS q FROM lineitem) AS l GROUP BY 1""",
)
def _precip_bins(m: Model):
    rows = m.inputs.lineitem.selectExpr("nullif(l_quantity - 3, 1D) as q")
    return rows.groupBy(weather.precip_bin("q").alias("precip_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("total")
    )


@register(
    "missing_rates",
    "snow_mm:f precip_mm:f tavg_c:f precip_bin:f",
    f"""SELECT avg(CASE WHEN snow_mm IS NULL THEN 1 ELSE 0 END) AS snow_mm,
               avg(CASE WHEN precip_mm IS NULL THEN 1 ELSE 0 END) AS precip_mm,
               avg(CASE WHEN tavg_c IS NULL THEN 1 ELSE 0 END) AS tavg_c,
               avg(CASE WHEN precip_bin IS NULL THEN 1 ELSE 0 END) AS precip_bin
        FROM ({WEATHER_SQL}) AS d""",
)
def _missing_rates(m: Model):
    return weather.missing_rates(_days(m), ["snow_mm", "precip_mm", "tavg_c", "precip_bin"])


def _acs_response(m: Model):
    code = acs.VARIABLES
    return m.inputs.customer.selectExpr(
        "c_name as NAME",
        f"cast(c_custkey % 50 as string) as {code['hh_no_vehicle']}",
        f"cast(c_custkey % 60 as string) as {code['hh_total']}",
        f"cast(c_custkey % 7 as string) as {code['workers_transit']}",
        f"if(c_custkey % 9 = 0, '-', cast(c_custkey % 40 as string)) as {code['workers_total']}",
        f"cast(c_custkey % 30 as string) as {code['persons_poverty']}",
        f"cast(cast(c_acctbal as bigint) as string) as {code['pop_total']}",
        "'08' as state", "'031' as county", "lpad(c_custkey, 6, '0') as tract",
    )


ACS_SQL = """
    SELECT concat('14000US08031', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS geoid,
           c_name AS name, 2023 AS year, c_custkey % 60 AS hh_total,
           CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 40 END AS workers_total,
           CAST(trunc(c_acctbal) AS BIGINT) AS pop_total,
           CASE WHEN c_custkey % 60 > 0
                THEN round((c_custkey % 50) / (c_custkey % 60), 4) END AS pct_hh_no_vehicle,
           CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 40 > 0
                THEN round((c_custkey % 7) / (c_custkey % 40), 4) END AS pct_transit_commute,
           CASE WHEN trunc(c_acctbal) > 0
                THEN round((c_custkey % 30) / trunc(c_acctbal), 4) END AS pct_poverty
    FROM customer"""


@register(
    "ratio_guard",
    "geoid:s name:s year:i hh_total:i workers_total:i pop_total:i pct_hh_no_vehicle:f "
    "pct_transit_commute:f pct_poverty:f",
    ACS_SQL,
)
def _ratio_guard(m: Model):
    return acs.demographics(_acs_response(m), 2023)


@register(
    "denominator_coverage",
    "hh_total:f workers_total:f pop_total:f",
    f"""SELECT avg(CASE WHEN hh_total > 0 THEN 1 ELSE 0 END) AS hh_total,
               avg(CASE WHEN workers_total > 0 THEN 1 ELSE 0 END) AS workers_total,
               avg(CASE WHEN pop_total > 0 THEN 1 ELSE 0 END) AS pop_total
        FROM ({ACS_SQL}) AS a""",
)
def _denominator_coverage(m: Model):
    return acs.denominator_coverage(acs.demographics(_acs_response(m), 2023))


@register(
    "gtfs_validation",
    "file:s row_count:i missing_columns:s valid:b",
    """SELECT 'stops.txt' AS file, count(*) AS row_count, '' AS missing_columns, true AS valid
       FROM part
       UNION ALL SELECT 'routes.txt', count(*), '', true FROM supplier
       UNION ALL SELECT 'trips.txt', count(*), '', true FROM customer
       UNION ALL SELECT 'stop_times.txt', count(*), 'stop_sequence', false FROM v_stop_times""",
)
def _gtfs_validation(m: Model):
    i = m.inputs
    return gtfs.validate(
        {
            "stops.txt": i.v_stops,
            "routes.txt": i.v_routes,
            "trips.txt": i.v_trips,
            "stop_times.txt": i.v_stop_times.drop("stop_sequence"),
        }
    )


# -- expressions ------------------------------------------------------------------------


@register(
    "local_time_parts",
    "event_id:i day:d hour:i",
    """SELECT event_id,
              CAST(timezone('America/Denver', timezone('UTC', moment)) AS DATE) AS day,
              hour(timezone('America/Denver', timezone('UTC', moment))) AS hour
       FROM (SELECT event_id, ts + to_hours(CAST(event_id % 8760 AS INTEGER)) AS moment
             FROM events) AS e""",
)
def _local_time_parts(m: Model):
    """Instants spread over a year, both clock changes included."""
    rows = m.inputs.events.selectExpr(
        "event_id",
        "cast(ts as timestamp) + make_interval(0, 0, 0, 0, cast(event_id % 8760 as int)) as moment",
    )
    zone = m.params.zone
    return rows.select(
        "event_id", local_date("moment", zone).alias("day"), local_hour("moment", zone).alias("hour")
    )


@register(
    "service_clock",
    "l_orderkey:i l_linenumber:i moment:t",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_partkey % 70 < 60 THEN timezone('UTC', timezone('America/Denver',
                   l_shipdate + to_hours(CAST(l_suppkey % 30 AS INTEGER))
                   + to_minutes(CAST(l_partkey % 70 AS INTEGER)) + INTERVAL 30 SECOND)) END AS moment
       FROM lineitem WHERE month(l_shipdate) NOT IN (3, 4, 10, 11)
       UNION ALL
       SELECT l_orderkey, l_linenumber,
              CASE WHEN l_partkey % 70 < 60 THEN timezone('UTC', timezone('America/Denver',
                   l_shipdate + INTERVAL 12 HOUR)) END
       FROM lineitem WHERE month(l_shipdate) IN (3, 4, 10, 11)""",
)
def _service_clock(m: Model):
    """Clock texts up to 29 hours; around the clock changes at noon, where time is unambiguous."""
    zone = m.params.zone
    rows = m.inputs.lineitem.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "cast(l_shipdate as date) as day",
        """if(month(l_shipdate) in (3, 4, 10, 11),
              if(l_partkey % 70 < 60, '12:00:00', '12:61:00'),
              concat(l_suppkey % 30, ':', lpad(l_partkey % 70, 2, '0'), ':30')) as text""",
    ).withColumn("sec", service_seconds("text"))
    return rows.withColumn("moment", service_instant("day", "sec", zone))


@register(
    "geo_distances",
    "stop_id:s to_center_m:f",
    """SELECT stop_id, 2 * 6371008.8::DOUBLE * asin(sqrt(
                  pow(sin(radians(39.74 - stop_lat) / 2), 2)
                  + cos(radians(stop_lat)) * cos(radians(39.74))
                    * pow(sin(radians(-104.99 - stop_lon) / 2), 2))) AS to_center_m
       FROM v_stops""",
)
def _geo_distances(m: Model):
    distance = geo.haversine_m("stop_lon", "stop_lat", "-104.99D", "39.74D")
    return m.inputs.v_stops.select("stop_id", distance.alias("to_center_m"))
