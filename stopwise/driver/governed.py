"""Queries of the mart surface, the data-quality checks and the export bookkeeping."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from stopwise.driver.catalog import register
from stopwise.driver.model import Model
from stopwise.plans import checks, lookups, query, staging
from stopwise.sinks import exports
from stopwise.sources import raw

# -- prepared questions -----------------------------------------------------------------


@register(
    "top_crash_stops",
    "stop_id:s crash_250m_cnt:i",
    """SELECT stop_id, crash_250m_cnt FROM b_crash_stop
       ORDER BY crash_250m_cnt DESC, stop_id LIMIT 20""",
)
def _top_crash_stops(m: Model):
    return query.top_crash_stops(m.crash_proximity)


@register(
    "worst_routes",
    "route_id:s avg_pct_on_time:f",
    """SELECT route_id, avg(pct_on_time) AS avg_pct_on_time FROM b_route_day
       WHERE service_date_mst >= DATE '2024-01-31' - 30
       GROUP BY route_id ORDER BY round(avg_pct_on_time, 12), route_id LIMIT 10""",
)
def _worst_routes(m: Model):
    return query.worst_routes(m.route_day, m.params)


@register(
    "delay_ratio",
    "route_id:s avg_delay_ratio:f avg_delay_seconds:f",
    """SELECT route_id, avg(1 - pct_on_time) AS avg_delay_ratio,
              avg(mean_delay_sec) AS avg_delay_seconds
       FROM b_route_day WHERE service_date_mst >= DATE '2024-01-31' - 30
       GROUP BY route_id ORDER BY round(avg_delay_ratio, 12) DESC, route_id LIMIT 10""",
)
def _delay_ratio(m: Model):
    return query.delay_ratio(m.route_day, m.params)


@register(
    "snow_effect",
    "route_id:s precip_bin:s delta_pct_on_time:f",
    """SELECT route_id, precip_bin, delta_pct_on_time FROM b_impacts
       WHERE precip_bin IN ('mod', 'heavy')
       ORDER BY delta_pct_on_time ASC NULLS FIRST, route_id, precip_bin LIMIT 10""",
)
def _snow_effect(m: Model):
    return query.snow_effect(m.impacts)


@register(
    "equity_gaps",
    "stop_id:s vuln_score_0_100:f reliability_score_0_100:f priority_score:f",
    """SELECT p.stop_id, v.vuln_score_0_100, r.reliability_score_0_100, p.priority_score
       FROM b_hotspots p JOIN b_vuln v USING (stop_id)
       JOIN (SELECT stop_id, 100 * (1 - avg(pct_on_time)) AS reliability_score_0_100
             FROM b_stop_hour WHERE service_date_mst >= DATE '2024-01-31' - 35
             GROUP BY stop_id) AS r USING (stop_id)
       ORDER BY round(p.priority_score, 9) DESC, stop_id LIMIT 20""",
)
def _equity_gaps(m: Model):
    return query.equity_gaps(m.hotspots, m.vulnerability, m.stop_hour, m.params)


# -- governed access --------------------------------------------------------------------


@register(
    "mart_query_filtered",
    "route_id:s service_date_mst:d precip_bin:s n_events:i pct_on_time:f",
    """SELECT * FROM b_route_day
       WHERE service_date_mst BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
         AND route_id IN ('R0', 'R1', 'R2', 'R5') AND precip_bin IN ('none', 'mod', 'heavy')""",
)
def _mart_query_filtered(m: Model):
    filters = query.Filters(
        date(2024, 1, 8), date(2024, 1, 21), ("R0", "R1", "R2", "R5"), "", ("none", "mod", "heavy")
    )
    marts = {"mart_reliability_by_route_day": m.route_day}
    return query.mart_query(marts, "mart_reliability_by_route_day", filters)


@register(
    "filter_options",
    "kind:s value:s",
    """SELECT 'route' AS kind, route_id AS value
       FROM (SELECT DISTINCT route_id FROM b_route_day WHERE route_id IS NOT NULL) AS r
       UNION ALL SELECT DISTINCT 'precip_bin', precip_bin FROM b_route_day
       UNION ALL SELECT 'date_min', CAST(min(service_date_mst) AS VARCHAR) FROM b_route_day
       UNION ALL SELECT 'date_max', CAST(max(service_date_mst) AS VARCHAR) FROM b_route_day""",
)
def _filter_options(m: Model):
    return query.filter_options(m.route_day)


@register(
    "enrich_result",
    "stop_id:s route_id:s n:i stop_name:s lat:f lon:f route_name:s route_long_name:s",
    """WITH r AS (SELECT stop_id, route_id, count(*) AS n FROM v_updates GROUP BY ALL)
       SELECT r.*, s.stop_name, s.stop_lat AS lat, s.stop_lon AS lon,
              coalesce(nullif(x.route_short_name, ''), x.route_long_name) AS route_name,
              x.route_long_name
       FROM r LEFT JOIN v_stops s USING (stop_id) LEFT JOIN v_routes x USING (route_id)""",
)
def _enrich_result(m: Model):
    result = m.inputs.v_updates.groupBy("stop_id", "route_id").agg(F.count(F.lit(1)).alias("n"))
    return query.enrich(result, lookups.gtfs_stops(m.stops), lookups.gtfs_routes(m.routes))


@register(
    "display_count",
    "total_rows:i",
    "SELECT count(*) AS total_rows FROM b_stop_hour",
)
def _display_count(m: Model):
    return query.display(m.stop_hour)[1]


@register(
    "freshness",
    "mart:s built_local:s latest_service_date:d age_days:f",
    """SELECT 'mart_reliability_by_route_day' AS mart, '2024-01-31 05:00' AS built_local,
              max(service_date_mst) AS latest_service_date, 0.0 AS age_days FROM b_route_day
       UNION ALL SELECT 'mart_weather_impacts', '2024-01-31 05:00', NULL, 0.0""",
)
def _freshness(m: Model):
    return query.freshness(
        {"mart_reliability_by_route_day": m.route_day, "mart_weather_impacts": m.impacts},
        m.params,
    )


@register(
    "export_rows",
    "stop_id:s service_date_mst:d event_hour_mst:i n_events:i",
    """SELECT * FROM b_stop_hour
       WHERE service_date_mst BETWEEN DATE '2024-01-02' AND DATE '2024-01-09'""",
)
def _export_rows(m: Model):
    return query.export_rows(
        m.stop_hour, "service_date_mst", date(2024, 1, 2), date(2024, 1, 9)
    )


# -- constraints ------------------------------------------------------------------------


@register(
    "dq_not_null",
    "entity_id:s feed_ts_utc:t",
    "SELECT entity_id, feed_ts_utc FROM v_updates WHERE trip_id IS NULL",
)
def _dq_not_null(m: Model):
    return checks.not_null(m.inputs.v_updates, "trip_id")


@register(
    "dq_unique",
    "l_orderkey:i l_linenumber:i n:i",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def _dq_unique(m: Model):
    return checks.unique(m.inputs.lineitem, ["l_orderkey", "l_linenumber"])


@register(
    "dq_relationships",
    "trip_id:s",
    """SELECT trip_id FROM v_stop_times
       WHERE trip_id NOT IN (SELECT trip_id FROM v_updates WHERE trip_id IS NOT NULL)""",
)
def _dq_relationships(m: Model):
    return checks.relationship(m.inputs.v_stop_times, "trip_id", m.inputs.v_updates, "trip_id")


@register(
    "dq_range",
    "value:f severity:s",
    """SELECT l_extendedprice AS value, 'warn' AS severity FROM lineitem
       WHERE l_extendedprice <= 2000 OR l_extendedprice > 90000""",
)
def _dq_range(m: Model):
    return checks.accepted_range(
        m.inputs.lineitem, "l_extendedprice", 2000, 90000, exclusive_low=True, severity="warn"
    )


@register(
    "dq_contract",
    "rule:s column_name:s",
    """SELECT 'missing' AS rule, 'route_desc' AS column_name
       UNION ALL SELECT 'unexpected', 'on_route'
       UNION ALL SELECT 'type', 'severity'
       UNION ALL SELECT 'all null', 'off_route'
       FROM (SELECT count(off_route) AS n FROM v_crashes) AS c WHERE n = 0""",
)
def _dq_contract(m: Model):
    found = m.inputs.v_crashes
    expected = [c for c in found.columns if c != "on_route"] + ["route_desc"]
    return checks.column_contract(found, expected, types={"severity": "int"})


@register(
    "qa_dup_profile",
    "groups:i groups_with_duplicates:i max_rows:i total_rows:i",
    """SELECT count(*) AS groups, count(*) FILTER (n > 1) AS groups_with_duplicates,
              max(n) AS max_rows, sum(n) AS total_rows
       FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) AS k""",
)
def _qa_dup_profile(m: Model):
    return checks.duplicate_profile(m.inputs.lineitem, ["l_orderkey", "l_linenumber"])


# -- feed and weather probes ------------------------------------------------------------


@register(
    "qa_snapshot_counts",
    "num_snapshots:i total_updates:i grade:s",
    """SELECT count(DISTINCT feed_ts_utc) AS num_snapshots, count(*) AS total_updates,
              CASE WHEN count(DISTINCT feed_ts_utc) >= 280 THEN 'PASS'
                   WHEN count(DISTINCT feed_ts_utc) >= 80 THEN 'WARN' ELSE 'FAIL' END AS grade
       FROM v_updates WHERE CAST(feed_ts_utc - INTERVAL 7 HOUR AS DATE) = DATE '2024-01-30'""",
)
def _qa_snapshot_counts(m: Model):
    return checks.snapshot_counts(m.inputs.v_updates, date(2024, 1, 30), m.params)


@register(
    "qa_vehicle_counts",
    "total_positions:i unique_vehicles:i num_snapshots:i grade:s",
    """SELECT count(*) AS total_positions, count(DISTINCT vehicle_id) AS unique_vehicles,
              count(DISTINCT feed_ts_utc) AS num_snapshots,
              CASE WHEN count(*) > 50000 THEN 'PASS' ELSE 'WARN' END AS grade
       FROM v_positions WHERE CAST(feed_ts_utc - INTERVAL 7 HOUR AS DATE) = DATE '2024-01-29'""",
)
def _qa_vehicle_counts(m: Model):
    return checks.vehicle_counts(m.inputs.v_positions, date(2024, 1, 29), m.params)


@register(
    "qa_daily_trend",
    "date_mst:d snapshots:i trip_updates:i",
    """SELECT CAST(feed_ts_utc - INTERVAL 7 HOUR AS DATE) AS date_mst,
              count(DISTINCT feed_ts_utc) AS snapshots, count(*) AS trip_updates
       FROM v_updates WHERE feed_ts_utc >= TIMESTAMP '2024-01-24 12:00:00' GROUP BY 1""",
)
def _qa_daily_trend(m: Model):
    return checks.daily_trend(m.inputs.v_updates, m.params)


@register(
    "qa_missing_hours",
    "missing_hour_mst:i",
    """SELECT h AS missing_hour_mst FROM range(24) AS r(h)
       WHERE h NOT IN (SELECT hour(feed_ts_utc - INTERVAL 7 HOUR) FROM v_updates
                       WHERE CAST(feed_ts_utc - INTERVAL 7 HOUR AS DATE) = DATE '2024-01-30')""",
)
def _qa_missing_hours(m: Model):
    return checks.missing_hours(m.inputs.v_updates, date(2024, 1, 30), m.params)


@register(
    "qa_missing_windows",
    "missing_from:t",
    """SELECT w AS missing_from
       FROM generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 23:55:00',
                            INTERVAL 5 MINUTE) AS g(w)
       WHERE w NOT IN (SELECT time_bucket(INTERVAL 5 MINUTE, event_ts_utc) FROM v_updates
                       WHERE event_ts_utc IS NOT NULL)""",
)
def _qa_missing_windows(m: Model):
    events = m.inputs.v_updates.select(F.col("event_ts_utc").alias("feed_ts_utc"))
    return checks.missing_windows(
        events,
        datetime(2024, 1, 1, tzinfo=UTC),
        datetime(2024, 1, 30, 23, 59, 59, tzinfo=UTC),
    )


@register(
    "qa_events_freshness",
    "latest_snapshot_mst:t minutes_ago:i unique_trips:i unique_routes:i total_events:i",
    """SELECT max(feed_ts_utc) - INTERVAL 7 HOUR AS latest_snapshot_mst,
              date_sub('minute', max(feed_ts_utc), TIMESTAMP '2024-01-31 12:00:00')
                  AS minutes_ago,
              count(DISTINCT trip_id) AS unique_trips, count(DISTINCT route_id) AS unique_routes,
              count(*) AS total_events
       FROM b_merged WHERE feed_ts_utc >= TIMESTAMP '2024-01-30 12:00:00'""",
)
def _qa_events_freshness(m: Model):
    return checks.events_freshness(m.merged, m.params, hours=24)


@register(
    "qa_weather_coverage",
    "latest_date:d days_behind:i days_covered:i days_with_precip:i pct_complete:f grade_days:s "
    "grade_complete:s",
    """WITH s AS (SELECT max(date) AS latest_date, count(DISTINCT date) AS days_covered,
                         count(precip_mm) AS days_with_precip,
                         round(count(precip_mm) / count(*) * 100, 1) AS pct_complete
                  FROM v_weather WHERE date >= DATE '2024-01-01')
       SELECT *, DATE '2024-01-31' - latest_date AS days_behind,
              CASE WHEN days_covered >= 25 THEN 'PASS' ELSE 'WARN' END AS grade_days,
              CASE WHEN pct_complete >= 70 THEN 'PASS' ELSE 'WARN' END AS grade_complete
       FROM s""",
)
def _qa_weather_coverage(m: Model):
    return checks.weather_coverage(m.inputs.v_weather, m.params)


@register(
    "qa_weather_loads",
    "date:d latest_ingest:t days_ago:i with_precip:i",
    """SELECT CAST(l_shipdate AS DATE) AS date, max(CAST(o_orderdate AS TIMESTAMP)) AS latest_ingest,
              DATE '2024-01-31' - CAST(l_shipdate AS DATE) AS days_ago,
              count(nullif(l_linenumber, 3)) AS with_precip
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY CAST(l_shipdate AS DATE)""",
)
def _qa_weather_loads(m: Model):
    i = m.inputs
    loads = i.lineitem.join(i.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.to_date("l_shipdate").alias("date"),
        F.col("o_orderdate").cast("timestamp").alias("_ingested_at"),
        F.nullif("l_linenumber", F.lit(3)).alias("precip_mm"),
    )
    return checks.weather_loads(loads, m.params, days=20_000)


@register(
    "qa_bin_share",
    "precip_bin:s num_days:i pct_of_days:f",
    """SELECT precip_bin, count(*) AS num_days,
              round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct_of_days
       FROM v_weather WHERE date >= DATE '2024-01-31' - 90 AND precip_bin IS NOT NULL
       GROUP BY precip_bin""",
)
def _qa_bin_share(m: Model):
    return checks.bin_share(m.inputs.v_weather, m.params)


@register(
    "qa_bin_diversity",
    "num_bins:i grade:s",
    """SELECT count(DISTINCT precip_bin) AS num_bins,
              CASE WHEN count(DISTINCT precip_bin) >= 3 THEN 'PASS' ELSE 'WARN' END AS grade
       FROM v_weather""",
)
def _qa_bin_diversity(m: Model):
    return checks.bin_diversity(m.inputs.v_weather, m.params)


@register(
    "qa_mart_overview",
    "first_date:d last_date:d transit_days:i unique_routes:i avg_on_time_pct:f grade:s",
    """SELECT min(service_date_mst) AS first_date, max(service_date_mst) AS last_date,
              count(DISTINCT service_date_mst) AS transit_days,
              count(DISTINCT route_id) AS unique_routes,
              round(avg(pct_on_time) * 100, 1) AS avg_on_time_pct,
              CASE WHEN count(DISTINCT service_date_mst) >= 30 THEN 'PASS'
                   WHEN count(DISTINCT service_date_mst) >= 1 THEN 'WARN' ELSE 'FAIL' END AS grade
       FROM b_route_day""",
)
def _qa_mart_overview(m: Model):
    return checks.mart_overview(m.route_day)


@register(
    "qa_impact_summary",
    "precip_bin:s routes_analyzed:i avg_on_time_pct:f avg_impact_pct_points:f",
    """SELECT precip_bin, count(DISTINCT route_id) AS routes_analyzed,
              round(avg(pct_on_time_avg) * 100, 1) AS avg_on_time_pct,
              round(avg(delta_pct_on_time) * 100, 1) AS avg_impact_pct_points
       FROM b_impacts GROUP BY precip_bin""",
)
def _qa_impact_summary(m: Model):
    return checks.impact_summary(m.impacts)


@register(
    "qa_range_union",
    "source:s first_date:d last_date:d total_days:i rainy_days:i",
    """SELECT 'Transit Data' AS source, min(service_date_mst) AS first_date,
              max(service_date_mst) AS last_date,
              count(DISTINCT service_date_mst) AS total_days, NULL AS rainy_days FROM b_route_day
       UNION ALL
       SELECT 'Weather Data', min(date), max(date), count(DISTINCT date),
              count(*) FILTER (precip_bin <> 'none') FROM v_weather""",
)
def _qa_range_union(m: Model):
    return checks.accumulation(m.route_day, m.inputs.v_weather, date(2023, 1, 1))


@register(
    "qa_coverage",
    "service_date_mst:d routes:i records:i",
    """SELECT service_date_mst, count(DISTINCT route_id) AS routes, count(*) AS records
       FROM b_route_day GROUP BY service_date_mst""",
)
def _qa_coverage(m: Model):
    return checks.coverage_by_date(m.route_day)


@register(
    "qa_consistency",
    "left_date:d right_date:d same_date:b pct_diff:i grade:s",
    """WITH l AS (SELECT max(o_orderdate) AS d, count(*) AS n FROM orders),
            r AS (SELECT max(l_shipdate) AS d, count(*) AS n FROM lineitem)
       SELECT l.d AS left_date, r.d AS right_date, l.d = r.d AS same_date,
              abs(l.n - r.n) * 100 // l.n AS pct_diff,
              CASE WHEN l.d <> r.d THEN 'WARN' WHEN abs(l.n - r.n) * 100 // l.n <= 5 THEN 'PASS'
                   ELSE 'WARN' END AS grade
       FROM l CROSS JOIN r""",
)
def _qa_consistency(m: Model):
    left = m.inputs.orders.select(F.to_date("o_orderdate").alias("service_date_mst"))
    right = m.inputs.lineitem.select(F.to_date("l_shipdate").alias("service_date_mst"))
    return checks.copies_agree(left, right)


# -- bookkeeping ------------------------------------------------------------------------

@register(
    "load_plan",
    "source_path:s extract_date:d hash_md5:s status:s reason:s",
    """WITH f AS (
           SELECT concat('drop/extract_date=', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '/',
                         o_orderkey, '.csv.gz') AS source_path,
                  CAST(o_orderdate AS DATE) AS d, md5(CAST(o_orderkey AS VARCHAR)) AS hash_md5,
                  o_orderstatus
           FROM orders)
       SELECT source_path, d AS extract_date, hash_md5,
              CASE WHEN d < DATE '1996-01-01' OR d > DATE '2000-12-31' THEN 'SKIP'
                   WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'LOAD' END AS status,
              CASE WHEN d < DATE '1996-01-01' THEN concat(d, ' is before 1996-01-01')
                   WHEN d > DATE '2000-12-31' THEN concat(d, ' is after 2000-12-31')
                   WHEN o_orderstatus = 'F' THEN 'same file in the ledger' END AS reason
       FROM f""",
)
def _load_plan(m: Model):
    path = (
        "concat('drop/extract_date=', cast(cast(o_orderdate as date) as string), '/', "
        "o_orderkey, '.csv.gz')"
    )
    files = m.inputs.orders.selectExpr(
        f"{path} as source_path", "md5(cast(o_orderkey as string)) as hash_md5", "o_orderstatus"
    ).withColumn("extract_date", raw.extract_date("source_path"))
    # The ledger knows finished orders, and stale hashes of open ones.
    ledger = files.selectExpr(
        "source_path as _source_path",
        "if(o_orderstatus = 'F', hash_md5, 'stale') as _hash_md5",
    )
    return raw.load_plan(files, ledger, date(1996, 1, 1), date(2000, 12, 31))


@register(
    "export_partitions",
    "service_date_mst:d",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS service_date_mst FROM lineitem
       WHERE CAST(l_shipdate AS DATE) >= DATE '2001-03-05'""",
)
def _export_partitions(m: Model):
    mart = m.inputs.lineitem.select(F.to_date("l_shipdate").alias("service_date_mst"))
    return exports.new_partitions(mart, date(2001, 3, 4), date(1999, 1, 1))


@register(
    "export_state_latest",
    "mart_name:s last_service_date:d last_run_ts:t",
    """SELECT concat('mart', o_custkey % 40) AS mart_name,
              CAST(o_orderdate AS DATE) AS last_service_date,
              CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS last_run_ts
       FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey % 40
               ORDER BY last_run_ts DESC NULLS LAST, last_service_date DESC NULLS LAST) = 1""",
)
def _export_state_latest(m: Model):
    states = m.inputs.orders.selectExpr(
        "concat('mart', o_custkey % 40) as mart_name",
        "cast(o_orderdate as date) as last_service_date",
        "case when o_orderkey % 10 <> 0 then cast(o_orderdate as timestamp) end as last_run_ts",
        "o_orderkey % 2 as store",
    )
    stores = [states.where(f"store = {i}").drop("store") for i in (0, 1)]
    return exports.freshest_state(*stores)


@register(
    "source_freshness",
    "latest:t age_days:f grade:s",
    """SELECT max(CAST(o_orderdate AS TIMESTAMP)) AS latest,
              (epoch(TIMESTAMP '2001-08-04 12:00:00') - epoch(max(o_orderdate))) / 86400.0
                  AS age_days, 'warn' AS grade FROM orders""",
)
def _source_freshness(m: Model):
    raws = m.inputs.orders.select(F.col("o_orderdate").cast("timestamp").alias("_ingested_at"))
    return raw.source_freshness(raws, datetime(2001, 8, 4, 12, tzinfo=UTC))


# -- latest records ---------------------------------------------------------------------


@register(
    "dedup_latest_demographics",
    "geoid:s year:i pop_total:i",
    """SELECT concat('G', o_custkey) AS geoid, year(o_orderdate) AS year,
              CAST(floor(o_totalprice) AS BIGINT) AS pop_total
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
           ORDER BY year(o_orderdate) DESC, o_orderdate DESC, pop_total DESC) = 1""",
)
def _dedup_latest_demographics(m: Model):
    absent = [c for c in staging.ACS_COLUMNS if c not in ("geoid", "year", "pop_total")]
    rows = m.inputs.orders.selectExpr(
        "concat('G', o_custkey) as geoid",
        "year(o_orderdate) as year",
        "cast(floor(o_totalprice) as bigint) as pop_total",
        "cast(o_orderdate as timestamp) as _ingested_at",
        *[f"cast(null as bigint) as {c}" for c in absent],
    )
    return staging.demographics(rows)


@register(
    "dedup_routes",
    "route_id:s route_name:s route_long_name:s route_type:s is_active:b",
    """SELECT concat('R', p_partkey % 50) AS route_id,
              coalesce(nullif(CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE '' END, ''), p_name) AS route_name, p_name AS route_long_name,
              CAST(p_size AS VARCHAR) AS route_type, true AS is_active
       FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 50
           ORDER BY p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, p_size) = 1""",
)
def _dedup_routes(m: Model):
    """Many names per route; the first by long name and description wins, a blank short name gives way."""
    return staging.routes(m.inputs.part.selectExpr(
        "concat('R', p_partkey % 50) as route_id", "p_name as route_long_name", "p_type as route_desc",
        "if(p_partkey % 3 = 0, '', p_brand) as route_short_name", "p_size as route_type",
    ))


@register(
    "dedup_stops",
    "stop_id:s stop_name:s stop_lat:f stop_lon:f wheelchair_boarding:i has_place:b",
    """SELECT *, stop_lat IS NOT NULL AND stop_lon IS NOT NULL AS has_place FROM (
           SELECT concat('S', l_partkey % 500) AS stop_id, nullif(l_returnflag, 'N') AS stop_name,
                  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS stop_lat, l_extendedprice AS stop_lon,
                  l_linenumber AS wheelchair_boarding
           FROM lineitem)
       QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY stop_name NULLS FIRST,
           stop_lat NULLS FIRST, stop_lon, wheelchair_boarding) = 1""",
)
def _dedup_stops(m: Model):
    """Stops that come back under other names and places, some without either."""
    stops = staging.stops(m.inputs.lineitem.selectExpr(
        "concat('S', l_partkey % 500) as stop_id", "nullif(l_returnflag, 'N') as stop_name",
        "if(l_linenumber = 3, null, l_quantity) as stop_lat", "l_extendedprice as stop_lon",
        "cast(l_linenumber as string) as wheelchair_boarding",
    ))
    return stops.withColumn("has_place", F.col("geom").isNotNull())


@register(
    "dedup_trips",
    "trip_id:s service_id:s route_id:s",
    """SELECT concat('T', o_custkey) AS trip_id, concat('W', o_orderkey % 7) AS service_id,
              concat('R', o_orderkey % 11) AS route_id
       FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)
       QUALIFY row_number() OVER (PARTITION BY o_custkey
           ORDER BY o_orderkey % 7, concat('R', o_orderkey % 11)) = 1""",
)
def _dedup_trips(m: Model):
    """Trips that several services of the newest extract claim, and older extracts too."""
    trips = m.inputs.orders.selectExpr(
        "concat('T', o_custkey) as trip_id", "concat('R', o_orderkey % 11) as route_id",
        "concat('W', o_orderkey % 7) as service_id", "cast(null as int) as direction_id",
        "cast(null as string) as shape_id", "cast(null as string) as trip_headsign",
        "make_date(year(o_orderdate), 1, 1) as _extract_date",
    )
    return staging.trips(trips, m.inputs.v_calendar, m.inputs.v_calendar_dates)


@register(
    "dedup_tracts",
    "geoid:s name:s aland_m2:i n_edges:i",
    """SELECT concat('G', o_custkey % 300) AS geoid, concat('N', o_orderkey) AS name, o_orderkey AS aland_m2,
              3 + o_orderkey % 2 AS n_edges
       FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 300
           ORDER BY o_orderdate DESC, concat('N', o_orderkey) DESC) = 1""",
)
def _dedup_tracts(m: Model):
    """Tracts of many loads with other rings: three corners, closed in the text or not, or four."""
    corner = "if(o_orderkey % 2 = 1, '[3,2],', '')"
    close = "if(o_custkey % 2 = 1, ',[0,0]', '')"
    rows = m.inputs.orders.selectExpr(
        "concat('G', o_custkey % 300) as geoid", "concat('N', o_orderkey) as name",
        "o_orderkey as aland_m2", "0L as awater_m2", "cast(o_orderdate as timestamp) as _ingested_at",
        "concat('{\"type\":\"Polygon\",\"coordinates\":[[[0,0],[1,0],', "
        f"{corner}, '[0,1]', {close}, ']]}}') as geometry_geojson",
    )
    return staging.tracts(rows).withColumn("n_edges", F.size("edges"))


@register(
    "dedup_latest_crashes",
    "crash_id:s event_ts_utc:t severity:i severity_text:s event_date_mst:d",
    """SELECT concat('C', l_orderkey) AS crash_id, CAST(l_shipdate AS TIMESTAMP) AS event_ts_utc,
              l_linenumber % 4 + 1 AS severity, l_returnflag AS severity_text,
              CAST(timezone('America/Denver', timezone('UTC', l_shipdate)) AS DATE)
                  AS event_date_mst
       FROM lineitem WHERE l_linenumber <> 5
       QUALIFY row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate DESC, severity DESC, l_returnflag DESC) = 1""",
)
def _dedup_latest_crashes(m: Model):
    rows = m.inputs.lineitem.selectExpr(
        "concat('C', l_orderkey) as crash_id",
        "cast(l_shipdate as timestamp) as event_ts_utc",
        "cast(l_linenumber % 4 + 1 as bigint) as severity",
        "l_returnflag as severity_text",
        "if(l_linenumber = 5, null, 1D) as lon",
        "2D as lat",
        *[f"cast(null as string) as {c}" for c in ("roadway_name", "on_route", "off_route")],
        *[f"cast(null as bigint) as {c}" for c in ("bike_involved", "ped_involved")],
    )
    return staging.crashes(rows, m.params)


@register(
    "dedup_latest_weather",
    "date:d station:s precip_mm:f",
    """SELECT CAST(l_shipdate AS DATE) AS date, concat('W', l_suppkey % 3) AS station,
              nullif(l_quantity, 7) AS precip_mm
       FROM lineitem QUALIFY row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey % 3
           ORDER BY l_orderkey DESC, precip_mm DESC NULLS LAST) = 1""",
)
def _dedup_latest_weather(m: Model):
    absent = [
        c for c in staging.WEATHER_COLUMNS if c not in ("date", "station", "precip_mm")
    ]
    rows = m.inputs.lineitem.selectExpr(
        "cast(l_shipdate as date) as date",
        "concat('W', l_suppkey % 3) as station",
        "nullif(l_quantity, 7D) as precip_mm",
        "timestamp_seconds(l_orderkey) as _ingested_at",
        *[f"cast(null as double) as {c}" for c in absent],
    )
    return staging.weather(rows)


@register(
    "qualify_first",
    "trip_id:s stop_id:s stop_sequence:i arrival_time:s arr_hour_gtfs:i",
    """SELECT concat('T', l_orderkey) AS trip_id, concat('S', l_suppkey % 2) AS stop_id,
              l_linenumber % 2 AS stop_sequence,
              concat(l_partkey % 30, ':00:00') AS arrival_time, 
              CAST(split_part(arrival_time, ':', 1) AS BIGINT) AS arr_hour_gtfs
       FROM lineitem QUALIFY row_number() OVER (
           PARTITION BY l_orderkey, l_suppkey % 2, l_linenumber % 2 ORDER BY arrival_time) = 1""",
)
def _qualify_first(m: Model):
    rows = m.inputs.lineitem.selectExpr(
        "concat('T', l_orderkey) as trip_id",
        "concat('S', l_suppkey % 2) as stop_id",
        "l_linenumber % 2 as stop_sequence",
        "concat(l_partkey % 30, ':00:00') as arrival_time",
        "cast(null as string) as departure_time",
        "date '2024-01-05' as _extract_date",
    )
    return staging.stop_times(rows)


@register(
    "latest_extract",
    "o_orderkey:i day:d",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""",
)
def _latest_extract(m: Model):
    from stopwise.operators.latest import newest_partition

    rows = m.inputs.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return newest_partition(rows, "day")
