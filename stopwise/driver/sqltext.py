"""DuckDB text of the building blocks, written from the definitions of the metrics.

Every block is a named subquery; ``with_blocks`` puts the ones a statement needs in front of it.
All event times of the given tables fall in January, when local time is UTC - 7 h.
"""

from __future__ import annotations

import re

from stopwise.driver.views import VIEWS, duckdb_view
from stopwise.functions.geo import DEG, EARTH_RADIUS_M, METERS_PER_DEGREE

LOCAL = "INTERVAL 7 HOUR"
KEY4 = "route_id, direction_id, stop_id, service_date_mst"


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    deg = repr(DEG)
    half = f"({deg}::DOUBLE / 2)"
    return (
        f"{2 * EARTH_RADIUS_M!r}::DOUBLE * asin(least(1.0::DOUBLE, sqrt("
        f"pow(sin(({lat2} - {lat1}) * {half}), 2) + cos({lat1} * {deg}::DOUBLE) "
        f"* cos({lat2} * {deg}::DOUBLE) * pow(sin(({lon2} - {lon1}) * {half}), 2))))"
    )


def clock(day: str, text: str) -> str:
    """HH:MM:SS on a date as an instant."""
    part = [f"TRY_CAST(split_part({text}, ':', {i}) AS INTEGER)" for i in (1, 2, 3)]
    return (
        f"(CAST({day} AS TIMESTAMP) + to_hours({part[0]}) + to_minutes({part[1]}) "
        f"+ to_seconds({part[2]}) + {LOCAL})"
    )


def seconds(later: str, earlier: str) -> str:
    return f"date_sub('second', {earlier}, {later})"


M = repr(METERS_PER_DEGREE) + "::DOUBLE"
DEG_SQL = repr(DEG) + "::DOUBLE"

BLOCKS: dict[str, str] = {
    # -- calendar and schedule
    "b_calendar": """
        SELECT *, CAST(try_strptime(nullif(start_date, ''), '%Y%m%d') AS DATE) AS s,
               CAST(try_strptime(nullif(end_date, ''), '%Y%m%d') AS DATE) AS e
        FROM v_calendar
        WHERE _extract_date = (SELECT max(_extract_date) FROM v_calendar)""",
    "b_exceptions": """
        SELECT service_id, exception_type, CAST(try_strptime(date, '%Y%m%d') AS DATE) AS day
        FROM v_calendar_dates
        WHERE _extract_date = (SELECT max(_extract_date) FROM v_calendar_dates)""",
    "b_spine": """
        SELECT CAST(d AS DATE) AS day, dayofweek(d) AS dow
        FROM generate_series(TIMESTAMP '2023-12-17', TIMESTAMP '2024-03-01', INTERVAL 1 DAY)
             AS g(d)""",
    "b_service_dates": """
        SELECT service_id, day AS service_date
        FROM b_calendar CROSS JOIN b_spine
        WHERE day >= s AND day <= e
          AND ((dow = 0 AND sunday = 1) OR (dow = 1 AND monday = 1) OR (dow = 2 AND tuesday = 1)
            OR (dow = 3 AND wednesday = 1) OR (dow = 4 AND thursday = 1)
            OR (dow = 5 AND friday = 1) OR (dow = 6 AND saturday = 1))
          AND NOT EXISTS (SELECT 1 FROM b_exceptions x WHERE x.service_id = b_calendar.service_id
                            AND x.day = b_spine.day AND x.exception_type = 2)
        UNION
        SELECT service_id, day FROM b_exceptions
        WHERE exception_type = 1 AND day BETWEEN DATE '2023-12-17' AND DATE '2024-03-01'""",
    "b_stop_times": """
        SELECT * FROM v_stop_times
        QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id, stop_sequence
                                   ORDER BY arrival_time NULLS FIRST, departure_time NULLS FIRST)
                = 1""",
    "b_sched": f"""
        SELECT t.trip_id, st.stop_id, st.stop_sequence, t.route_id, t.direction_id,
               CASE WHEN nullif(st.arrival_time, '') IS NOT NULL
                    THEN {clock('sd.service_date', 'st.arrival_time')} END AS arr,
               CASE WHEN nullif(st.departure_time, '') IS NOT NULL
                    THEN {clock('sd.service_date', 'st.departure_time')} END AS dep,
               sd.service_date AS service_date_mst
        FROM v_trips t JOIN b_service_dates sd USING (service_id)
        JOIN b_stop_times st ON st.trip_id = t.trip_id
        WHERE nullif(st.arrival_time, '') IS NOT NULL
           OR nullif(st.departure_time, '') IS NOT NULL""",
    # -- realtime events
    "b_merged": """
        SELECT * FROM (
            SELECT coalesce(u.feed_ts_utc, p.feed_ts_utc) AS feed_ts_utc,
                   coalesce(u.trip_id, p.trip_id) AS trip_id,
                   coalesce(u.route_id, p.route_id) AS route_id,
                   u.entity_id AS tu_entity_id, p.entity_id AS vp_entity_id,
                   u.stop_id, u.stop_sequence, u.arrival_delay_sec, u.departure_delay_sec,
                   u.schedule_relationship, p.vehicle_id, p.vehicle_label, p.lon, p.lat,
                   p.bearing, p.speed_mps,
                   coalesce(u.event_ts_utc, p.event_ts_utc, u.feed_ts_utc, p.feed_ts_utc)
                       AS event_ts_utc
            FROM (SELECT * FROM v_updates WHERE feed_ts_utc >= TIMESTAMP '2023-12-17 12:00:00') u
            FULL OUTER JOIN
                 (SELECT * FROM v_positions WHERE feed_ts_utc >= TIMESTAMP '2023-12-17 12:00:00') p
              ON u.feed_ts_utc = p.feed_ts_utc AND u.trip_id = p.trip_id
             AND u.route_id = p.route_id) AS j
        QUALIFY row_number() OVER (
            PARTITION BY feed_ts_utc, trip_id
            ORDER BY event_ts_utc DESC NULLS LAST, tu_entity_id DESC NULLS LAST,
                     vp_entity_id DESC NULLS LAST, stop_sequence DESC NULLS LAST,
                     stop_id DESC NULLS LAST, arrival_delay_sec DESC NULLS LAST,
                     departure_delay_sec DESC NULLS LAST, schedule_relationship DESC NULLS LAST,
                     vehicle_id DESC NULLS LAST, vehicle_label DESC NULLS LAST,
                     lon DESC NULLS LAST, lat DESC NULLS LAST, bearing DESC NULLS LAST,
                     speed_mps DESC NULLS LAST, route_id DESC NULLS LAST) = 1""",
    "b_events": f"""
        SELECT m.* EXCLUDE (arrival_delay_sec, departure_delay_sec),
               m.arrival_delay_sec AS arrival_raw, m.departure_delay_sec AS departure_raw,
               coalesce(m.arrival_delay_sec, {seconds('m.event_ts_utc', 's.arr')})
                   AS arrival_delay_sec,
               coalesce(m.departure_delay_sec, {seconds('m.event_ts_utc', 's.dep')})
                   AS departure_delay_sec,
               t.direction_id, t.trip_headsign,
               CAST(m.event_ts_utc - {LOCAL} AS DATE) AS event_date_mst,
               hour(m.event_ts_utc - {LOCAL}) AS event_hour_mst
        FROM b_merged m
        LEFT JOIN v_trips t ON t.trip_id = m.trip_id
        LEFT JOIN b_sched s ON s.trip_id = m.trip_id AND s.stop_id = m.stop_id
              AND s.stop_sequence = m.stop_sequence
              AND s.service_date_mst = CAST(m.event_ts_utc - {LOCAL} AS DATE)""",
    "b_resolved": """
        SELECT route_id, trip_id, stop_id, direction_id, event_date_mst AS service_date_mst,
               event_hour_mst, event_ts_utc,
               coalesce(arrival_delay_sec, departure_delay_sec) AS delay_sec_raw,
               coalesce(arrival_delay_sec, departure_delay_sec, 0) AS delay_sec,
               CASE WHEN abs(coalesce(arrival_delay_sec, departure_delay_sec, 0)) <= 300
                    THEN 1 ELSE 0 END AS is_on_time
        FROM b_events""",
    # -- headways
    "b_obs": f"""
        SELECT *, {seconds('event_ts_utc', 'prev')} AS obs_headway_sec
        FROM (SELECT *, lag(event_ts_utc) OVER (PARTITION BY {KEY4} ORDER BY event_ts_utc) AS prev
              FROM (SELECT DISTINCT {KEY4}, event_ts_utc FROM b_resolved
                    WHERE event_ts_utc IS NOT NULL
                      AND service_date_mst >= DATE '2023-12-17') AS o) AS l""",
    "b_sch": f"""
        SELECT *, {seconds('arr', 'prev')} AS sch_headway_sec
        FROM (SELECT *, lag(arr) OVER (PARTITION BY {KEY4} ORDER BY arr) AS prev
              FROM (SELECT DISTINCT {KEY4}, arr FROM b_sched WHERE arr IS NOT NULL) AS s) AS l""",
    "b_nearest": f"""
        SELECT o.route_id, o.direction_id, o.stop_id, o.service_date_mst, o.event_ts_utc,
               o.obs_headway_sec, s.sch_headway_sec, s.arr,
               abs({seconds('o.event_ts_utc', 's.arr')}) AS dt_abs
        FROM b_obs o JOIN b_sch s
          ON o.route_id = s.route_id AND coalesce(o.direction_id, -1) = coalesce(s.direction_id, -1)
         AND o.stop_id = s.stop_id AND o.service_date_mst = s.service_date_mst
        WHERE o.obs_headway_sec IS NOT NULL AND s.sch_headway_sec IS NOT NULL
        QUALIFY row_number() OVER (
            PARTITION BY o.route_id, o.direction_id, o.stop_id, o.service_date_mst, o.event_ts_utc
            ORDER BY abs({seconds('o.event_ts_utc', 's.arr')}), s.arr) = 1""",
    "b_adherence": """
        SELECT *, CASE WHEN dt_abs <= 1800 AND sch_headway_sec > 0
                        AND abs(obs_headway_sec - sch_headway_sec)
                            / nullif(sch_headway_sec, 0) <= 0.5
                       THEN 1 ELSE 0 END AS headway_adherent
        FROM b_nearest""",
    # -- weather and reliability
    "b_weather_day": """
        SELECT date AS service_date_mst, max(coalesce(snow_day, 0)) > 0 AS snow_day,
               arg_max(precip_bin, (coalesce(precip_mm, '-inf'::DOUBLE), precip_bin))
                   FILTER (WHERE precip_bin IS NOT NULL) AS precip_bin
        FROM v_weather WHERE station = 'USW00023062' GROUP BY date""",
    "b_weather_all": """
        SELECT date AS service_date_mst, max(coalesce(snow_day, 0)) > 0 AS snow_day,
               arg_max(precip_bin, (coalesce(precip_mm, '-inf'::DOUBLE), precip_bin))
                   FILTER (WHERE precip_bin IS NOT NULL) AS precip_bin
        FROM v_weather GROUP BY date""",
    "b_route_day": """
        SELECT e.route_id, e.service_date_mst, coalesce(w.precip_bin, 'none') AS precip_bin,
               coalesce(w.snow_day, false) AS snow_day, count(*) AS n_events,
               count(delay_sec_raw) AS n_reported_events,
               avg(CASE WHEN abs(delay_sec) <= 300 THEN 1 ELSE 0 END) AS pct_on_time,
               avg(delay_sec) AS mean_delay_sec,
               quantile_disc(delay_sec, 0.5) AS median_delay_sec,
               quantile_disc(delay_sec, 0.9) AS p90_delay_sec
        FROM b_resolved e LEFT JOIN b_weather_day w USING (service_date_mst)
        GROUP BY ALL""",
    "b_route_mode": """
        SELECT stop_id, service_date_mst, event_hour_mst, route_id AS route_id_mode
        FROM (SELECT stop_id, service_date_mst, event_hour_mst, route_id, count(*) AS n
              FROM b_resolved WHERE stop_id IS NOT NULL AND route_id IS NOT NULL
              GROUP BY ALL) AS c
        QUALIFY row_number() OVER (PARTITION BY stop_id, service_date_mst, event_hour_mst
                                   ORDER BY n DESC, route_id) = 1""",
    "b_stop_hour": f"""
        WITH head AS (
            SELECT stop_id, service_date_mst, hour(event_ts_utc - {LOCAL}) AS event_hour_mst,
                   avg(headway_adherent) AS headway_adherence_rate,
                   quantile_disc(obs_headway_sec, 0.5) AS obs_headway_sec_p50,
                   quantile_disc(obs_headway_sec, 0.9) AS obs_headway_sec_p90
            FROM b_adherence GROUP BY ALL),
        agg AS (
            SELECT stop_id, service_date_mst, event_hour_mst, count(*) AS n_events,
                   avg(CASE WHEN abs(delay_sec) <= 300 THEN 1 ELSE 0 END) AS pct_on_time,
                   avg(delay_sec) AS mean_delay_sec,
                   quantile_disc(delay_sec, 0.9) AS p90_delay_sec
            FROM b_resolved WHERE stop_id IS NOT NULL GROUP BY ALL)
        SELECT agg.*, coalesce(route_id_mode, 'unknown') AS route_id_mode,
               headway_adherence_rate, obs_headway_sec_p50, obs_headway_sec_p90
        FROM agg LEFT JOIN head USING (stop_id, service_date_mst, event_hour_mst)
        LEFT JOIN b_route_mode USING (stop_id, service_date_mst, event_hour_mst)""",
    "b_impacts": """
        WITH a AS (SELECT route_id, precip_bin, avg(pct_on_time) AS pct_on_time_avg
                   FROM b_route_day GROUP BY ALL)
        SELECT a.route_id, a.precip_bin, a.pct_on_time_avg,
               n.pct_on_time_avg AS pct_on_time_normal,
               a.pct_on_time_avg - n.pct_on_time_avg AS delta_pct_on_time
        FROM a LEFT JOIN a n ON a.route_id = n.route_id AND n.precip_bin = 'none'""",
    # -- places
    "b_crash_pairs": f"""
        SELECT * FROM (
            SELECT s.stop_id, c.crash_id, c.severity,
                   {haversine('s.stop_lon', 's.stop_lat', 'c.lon', 'c.lat')} AS distance_m
            FROM v_stops s JOIN (
                SELECT * FROM v_crashes
                WHERE CAST(event_ts_utc AS DATE) BETWEEN
                      (SELECT CAST(max(event_ts_utc) AS DATE) - 365 FROM v_crashes)
                  AND (SELECT CAST(max(event_ts_utc) AS DATE) FROM v_crashes)) c
              ON c.lat BETWEEN s.stop_lat - 0.0025 AND s.stop_lat + 0.0025
             AND abs(c.lon - s.stop_lon) <= 0.0045) AS d
        WHERE distance_m <= 250""",
    "b_crash_stop": """
        WITH a AS (
            SELECT stop_id, count(*) FILTER (distance_m <= 100) AS crash_100m_cnt,
                   count(*) FILTER (distance_m <= 100 AND severity >= 3) AS severe_100m_cnt,
                   count(*) FILTER (distance_m <= 100 AND severity = 4) AS fatal_100m_cnt,
                   count(*) AS crash_250m_cnt,
                   count(*) FILTER (severity >= 3) AS severe_250m_cnt,
                   count(*) FILTER (severity = 4) AS fatal_250m_cnt
            FROM b_crash_pairs GROUP BY stop_id)
        SELECT s.stop_id,
               (SELECT CAST(max(event_ts_utc) AS DATE) FROM v_crashes) AS as_of_date,
               365 AS window_days,
               coalesce(crash_100m_cnt, 0) AS crash_100m_cnt,
               coalesce(severe_100m_cnt, 0) AS severe_100m_cnt,
               coalesce(fatal_100m_cnt, 0) AS fatal_100m_cnt,
               coalesce(crash_250m_cnt, 0) AS crash_250m_cnt,
               coalesce(severe_250m_cnt, 0) AS severe_250m_cnt,
               coalesce(fatal_250m_cnt, 0) AS fatal_250m_cnt
        FROM v_stops s LEFT JOIN a USING (stop_id)""",
    "b_chords": f"""
        SELECT stop_id,
               (k.lon_start - s.stop_lon) * {M} * cos(s.stop_lat * {DEG_SQL}) AS x1,
               (k.lat_start - s.stop_lat) * {M} AS y1,
               (k.lon_end - s.stop_lon) * {M} * cos(s.stop_lat * {DEG_SQL}) AS x2,
               (k.lat_end - s.stop_lat) * {M} AS y2
        FROM v_stops s JOIN v_sidewalks k
          ON k.lat_start BETWEEN s.stop_lat - 0.02 AND s.stop_lat + 0.02
         AND k.lon_start BETWEEN s.stop_lon - 0.02 AND s.stop_lon + 0.02""",
    "b_sidewalk_len": """
        WITH q AS (
            SELECT stop_id, sqrt(a) AS len, b / a AS p,
                   (b / a) * (b / a) - (c - 200.0 * 200.0) / a AS disc
            FROM (SELECT stop_id, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS a,
                         x1 * (x2 - x1) + y1 * (y2 - y1) AS b, x1 * x1 + y1 * y1 AS c
                  FROM b_chords) AS r WHERE a > 0),
        lens AS (
            SELECT stop_id, greatest(0, least(1, sqrt(disc) - p)
                                        - greatest(0, -p - sqrt(disc))) * len AS inside
            FROM q WHERE disc > 0)
        SELECT s.stop_id, coalesce(sum(inside), 0) AS len_m
        FROM v_stops s LEFT JOIN lens USING (stop_id) GROUP BY s.stop_id""",
    "b_access": """
        SELECT stop_id, 200 AS buffer_m, len_m AS sidewalk_len_m_within_200m,
               round(CASE WHEN max(len_m) OVER () = min(len_m) OVER () THEN 100
                          ELSE (len_m - min(len_m) OVER ())
                               / nullif(max(len_m) OVER () - min(len_m) OVER (), 0) * 100 END, 1)
                   AS access_score_0_100
        FROM b_sidewalk_len""",
    "b_edges": """
        WITH rings AS (
            SELECT geoid, unnest(CAST(json_extract(geometry_geojson, '$.coordinates')
                                      AS DOUBLE[][][])) AS ring
            FROM v_tracts),
        steps AS (SELECT geoid, ring, unnest(range(1, len(ring))) AS i FROM rings)
        SELECT geoid, ring[i][1] AS lon1, ring[i][2] AS lat1,
               ring[i + 1][1] AS lon2, ring[i + 1][2] AS lat2
        FROM steps""",
    "b_near": f"""
        WITH pair AS (
            SELECT s.stop_id, e.geoid,
                   (e.lon1 - s.stop_lon) * {M} * cos(s.stop_lat * {DEG_SQL}) AS x1,
                   (e.lat1 - s.stop_lat) * {M} AS y1,
                   (e.lon2 - s.stop_lon) * {M} * cos(s.stop_lat * {DEG_SQL}) AS x2,
                   (e.lat2 - s.stop_lat) * {M} AS y2
            FROM v_stops s
            JOIN (SELECT geoid, min(lon1) AS w, max(lon1) AS e, min(lat1) AS s, max(lat1) AS n
                  FROM b_edges GROUP BY geoid) AS box
              ON s.stop_lat BETWEEN box.s - 0.01 AND box.n + 0.01
             AND s.stop_lon BETWEEN box.w - 0.015 AND box.e + 0.015
            JOIN b_edges e ON e.geoid = box.geoid),
        seg AS (
            SELECT *, greatest(0, least(1, -(x1 * (x2 - x1) + y1 * (y2 - y1))
                       / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t
            FROM pair),
        dist AS (
            SELECT stop_id, geoid,
                   min((x1 + t * (x2 - x1)) * (x1 + t * (x2 - x1))
                       + (y1 + t * (y2 - y1)) * (y1 + t * (y2 - y1))) AS d2,
                   count(*) FILTER ((y1 > 0) <> (y2 > 0)
                       AND x1 - y1 * (x2 - x1) / nullif(y2 - y1, 0) > 0) AS crossings
            FROM seg GROUP BY stop_id, geoid)
        SELECT stop_id, geoid,
               CASE WHEN crossings % 2 = 1 THEN 0 ELSE sqrt(d2) END AS distance_m
        FROM dist WHERE crossings % 2 = 1 OR sqrt(d2) <= 804.672""",
    "b_vuln_raw": """
        WITH a AS (SELECT regexp_replace(geoid, '^14000US', '') AS geoid, pop_total,
                          pct_hh_no_vehicle, pct_transit_commute, pct_poverty
                   FROM v_acs WHERE pop_total > 0),
        n AS (
            SELECT stop_id,
                   sum(pct_hh_no_vehicle * pop_total) / nullif(sum(pop_total), 0)
                       AS pct_hh_no_vehicle_w,
                   sum(pct_transit_commute * pop_total) / nullif(sum(pop_total), 0)
                       AS pct_transit_commute_w,
                   sum(pct_poverty * pop_total) / nullif(sum(pop_total), 0) AS pct_poverty_w
            FROM b_near JOIN a USING (geoid) GROUP BY stop_id)
        SELECT s.stop_id, pct_hh_no_vehicle_w, pct_transit_commute_w, pct_poverty_w,
               (pct_hh_no_vehicle_w + pct_transit_commute_w + pct_poverty_w) / 3.0 AS raw
        FROM v_stops s LEFT JOIN n USING (stop_id)""",
    "b_vuln": """
        SELECT * EXCLUDE (raw),
               round(CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 100
                          ELSE (raw - min(raw) OVER ())
                               / nullif(max(raw) OVER () - min(raw) OVER (), 0) * 100 END, 1)
                   AS vuln_score_0_100
        FROM b_vuln_raw""",
    "b_hotspots": """
        WITH rel AS (SELECT stop_id, 100.0 * (1 - avg(pct_on_time)) AS reliability_score_0_100
                     FROM b_stop_hour WHERE service_date_mst >= DATE '2024-01-31' - 35
                     GROUP BY stop_id),
        cr AS (SELECT stop_id,
                      round((crash_250m_cnt - min(crash_250m_cnt) OVER ())
                            / nullif(max(crash_250m_cnt) OVER () - min(crash_250m_cnt) OVER (), 0)
                            * 100, 1) AS crash_score_0_100
               FROM b_crash_stop),
        scored AS (
            SELECT stop_id, vuln_score_0_100, crash_score_0_100, reliability_score_0_100,
                   0.5 * coalesce(vuln_score_0_100, 0)::DOUBLE
                   + 0.3 * coalesce(crash_score_0_100, 0)::DOUBLE
                   + 0.2 * coalesce(reliability_score_0_100, 0)::DOUBLE AS priority_score
            FROM (SELECT stop_id, vuln_score_0_100 FROM b_vuln) AS v
            FULL OUTER JOIN cr USING (stop_id) FULL OUTER JOIN rel USING (stop_id))
        SELECT *, dense_rank() OVER (ORDER BY round(priority_score, 9) DESC) AS priority_rank
        FROM scored WHERE stop_id IS NOT NULL""",
}


def with_blocks(sql: str) -> str:
    """The statement with every block and view it uses, in dependency order, in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[bv]_\w+", text):
            if name in order or (name not in BLOCKS and name not in VIEWS):
                continue
            body = BLOCKS.get(name) or duckdb_view(name)
            need(body)
            if name not in order:
                order.append(name)

    need(sql)
    bodies = [f"{n} AS ({BLOCKS.get(n) or duckdb_view(n)})" for n in order]
    return f"WITH {', '.join(bodies)} {sql}" if bodies else sql
