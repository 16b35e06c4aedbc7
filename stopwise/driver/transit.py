"""Queries of the transit plans: schedule, events, headways, reliability and places."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from stopwise.driver.catalog import register
from stopwise.driver.model import Model
from stopwise.driver.sqltext import haversine
from stopwise.driver.views import range_of, range_sql
from stopwise.functions.clock import date_spine
from stopwise.plans import lookups, places, reliability

# -- schedule ---------------------------------------------------------------------------


@register(
    "date_spine",
    "service_date:d day_of_week:s is_sunday:b is_saturday:b n_orders:i",
    f"""SELECT d.day AS service_date, lower(dayname(d.day)) AS day_of_week,
              dayofweek(d.day) = 0 AS is_sunday, dayofweek(d.day) = 6 AS is_saturday,
              coalesce(o.n, 0) AS n_orders
       FROM ({range_sql('orders', 'o_orderdate')}) AS d
       LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders
                  GROUP BY 1) AS o ON o.day = d.day""",
)
def _date_spine(m: Model):
    spine = date_spine(m.inputs.spark, *range_of(m.inputs.orders, "o_orderdate"))
    per_day = m.inputs.orders.groupBy(F.to_date("o_orderdate").alias("service_date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return spine.join(per_day, "service_date", "left").withColumn(
        "n_orders", F.coalesce("n", F.lit(0))
    )


@register("service_dates", "service_id:s service_date:d", "SELECT * FROM b_service_dates")
def _service_dates(m: Model):
    return m.service_dates


@register(
    "scheduled_arrivals",
    "trip_id:s stop_id:s stop_sequence:i route_id:s direction_id:i sched_arrival_ts_mst:t "
    "sched_departure_ts_mst:t service_date_mst:d",
    """SELECT trip_id, stop_id, stop_sequence, route_id, direction_id,
              arr AS sched_arrival_ts_mst, dep AS sched_departure_ts_mst, service_date_mst
       FROM b_sched""",
)
def _scheduled_arrivals(m: Model):
    return m.scheduled


@register(
    "trip_service_arrays",
    "trip_id:s service_id:s wednesday:i start_date:s added_service_dates:a "
    "removed_service_dates:a",
    """WITH x AS (
           SELECT service_id,
                  list_sort(list_distinct(list(date) FILTER (exception_type = 1)))
                      AS added_service_dates,
                  list_sort(list_distinct(list(date) FILTER (exception_type = 2)))
                      AS removed_service_dates
           FROM v_calendar_dates
           WHERE _extract_date = (SELECT max(_extract_date) FROM v_calendar_dates)
           GROUP BY service_id)
       SELECT t.trip_id, t.service_id, c.wednesday, c.start_date, x.added_service_dates,
              x.removed_service_dates
       FROM v_trips t LEFT JOIN b_calendar c USING (service_id) LEFT JOIN x USING (service_id)""",
)
def _trip_service_arrays(m: Model):
    return m.trips


# -- realtime events --------------------------------------------------------------------

EVENT_COLUMNS = (
    "feed_ts_utc:t trip_id:s route_id:s tu_entity_id:s vp_entity_id:s stop_id:s "
    "stop_sequence:i schedule_relationship:s vehicle_id:s vehicle_label:s lon:f lat:f "
    "bearing:f speed_mps:f event_ts_utc:t arrival_delay_sec:i departure_delay_sec:i"
)


@register("rt_full_outer_resolve", EVENT_COLUMNS, "SELECT * FROM b_merged")
def _rt_full_outer_resolve(m: Model):
    return m.merged


@register(
    "rt_delay_from_schedule",
    EVENT_COLUMNS + " direction_id:i trip_headsign:s event_date_mst:d event_hour_mst:i",
    "SELECT * FROM b_events",
)
def _rt_delay_from_schedule(m: Model):
    return m.events


@register(
    "resolved_on_time",
    "route_id:s trip_id:s stop_id:s direction_id:i service_date_mst:d event_hour_mst:i "
    "event_ts_utc:t delay_sec:i delay_sec_raw:i is_on_time:i",
    "SELECT * FROM b_resolved",
)
def _resolved_on_time(m: Model):
    return m.resolved


# -- headways ---------------------------------------------------------------------------

HEADWAY_KEYS = "route_id:s direction_id:i stop_id:s service_date_mst:d "


@register(
    "headways_observed",
    HEADWAY_KEYS + "event_ts_utc:t obs_headway_sec:i",
    "SELECT * FROM b_obs",
)
def _headways_observed(m: Model):
    return m.observed


@register(
    "headways_scheduled",
    HEADWAY_KEYS + "sched_arrival_ts_mst:t sch_headway_sec:i",
    "SELECT *, arr AS sched_arrival_ts_mst FROM b_sch",
)
def _headways_scheduled(m: Model):
    return m.scheduled_headways


@register(
    "nearest_schedule",
    HEADWAY_KEYS
    + "event_ts_utc:t obs_headway_sec:i sched_arrival_ts_mst:t sch_headway_sec:i dt_abs:i",
    "SELECT *, arr AS sched_arrival_ts_mst FROM b_nearest",
)
def _nearest_schedule(m: Model):
    return m.nearest


@register(
    "headway_adherence",
    HEADWAY_KEYS
    + "event_ts_utc:t obs_headway_sec:i sch_headway_sec:i dt_abs:i headway_adherent:i",
    "SELECT * FROM b_adherence",
)
def _headway_adherence(m: Model):
    return m.adherence


# -- reliability ------------------------------------------------------------------------

ROUTE_DAY_COLUMNS = (
    "route_id:s service_date_mst:d precip_bin:s snow_day:b n_events:i n_reported_events:i "
    "pct_on_time:f mean_delay_sec:f median_delay_sec:i p90_delay_sec:i"
)


@register("route_day_reliability", ROUTE_DAY_COLUMNS, "SELECT * FROM b_route_day")
def _route_day_reliability(m: Model):
    return m.route_day


# Groups are below the size at which the quantile sketch rounds, so both forms give the same.
@register("route_day_reliability_exact", ROUTE_DAY_COLUMNS, "SELECT * FROM b_route_day")
def _route_day_reliability_exact(m: Model):
    return m.route_day_exact


STOP_HOUR_COLUMNS = (
    "stop_id:s service_date_mst:d event_hour_mst:i n_events:i pct_on_time:f mean_delay_sec:f "
    "p90_delay_sec:i route_id_mode:s headway_adherence_rate:f obs_headway_sec_p50:i "
    "obs_headway_sec_p90:i"
)


@register("stop_hour_reliability", STOP_HOUR_COLUMNS, "SELECT * FROM b_stop_hour")
def _stop_hour_reliability(m: Model):
    return m.stop_hour


@register("stop_hour_reliability_exact", STOP_HOUR_COLUMNS, "SELECT * FROM b_stop_hour")
def _stop_hour_reliability_exact(m: Model):
    return m.stop_hour_exact


@register(
    "route_mode_by_stop_hour",
    "stop_id:s service_date_mst:d event_hour_mst:i route_id_mode:s",
    "SELECT * FROM b_route_mode",
)
def _route_mode_by_stop_hour(m: Model):
    delays = reliability.stop_hour_delays(m.resolved, m.params)
    return delays.where("route_id_mode <> 'unknown'")


@register(
    "weather_by_date",
    "service_date_mst:d snow_day:b precip_bin:s",
    "SELECT * FROM b_weather_day",
)
def _weather_by_date(m: Model):
    return m.weather_days


@register(
    "weather_by_date_all_stations",
    "service_date_mst:d snow_day:b precip_bin:s",
    "SELECT * FROM b_weather_all",
)
def _weather_by_date_all_stations(m: Model):
    from dataclasses import replace

    return reliability.weather_by_date(m.weather, replace(m.params, weather_station=None))


@register(
    "weather_impacts",
    "route_id:s precip_bin:s pct_on_time_avg:f pct_on_time_normal:f delta_pct_on_time:f",
    "SELECT * FROM b_impacts",
)
def _weather_impacts(m: Model):
    return m.impacts


# -- places -----------------------------------------------------------------------------


@register(
    "crash_distance_join",
    "stop_id:s crash_id:s severity:i distance_m:f",
    "SELECT * FROM b_crash_pairs",
)
def _crash_distance_join(m: Model):
    return places.crash_pairs(m.stops, m.crashes, m.params)


@register(
    "crash_proximity",
    "stop_id:s as_of_date:d window_days:i crash_100m_cnt:i severe_100m_cnt:i fatal_100m_cnt:i "
    "crash_250m_cnt:i severe_250m_cnt:i fatal_250m_cnt:i",
    "SELECT * FROM b_crash_stop",
)
def _crash_proximity(m: Model):
    return m.crash_proximity


@register(
    "sidewalk_clip_length",
    "stop_id:s sidewalk_len_m_within_200m:f",
    "SELECT stop_id, len_m AS sidewalk_len_m_within_200m FROM b_sidewalk_len",
)
def _sidewalk_clip_length(m: Model):
    return places.sidewalk_length_by_stop(m.stops, m.sidewalks, m.params)


@register(
    "access_score",
    "stop_id:s buffer_m:i sidewalk_len_m_within_200m:f access_score_0_100:f",
    "SELECT * FROM b_access",
)
def _access_score(m: Model):
    return m.access


@register(
    "tract_catchment",
    "stop_id:s geoid:s distance_m:f",
    "SELECT * FROM b_near",
)
def _tract_catchment(m: Model):
    near = places.tract_catchment(m.stops, m.tracts, m.params).select(
        "lon", "lat", "geoid", "distance_m"
    )
    placed = m.stops.select("stop_id", "geom.lon", "geom.lat")
    return placed.join(near, ["lon", "lat"])


@register(
    "vulnerability",
    "stop_id:s pct_hh_no_vehicle_w:f pct_transit_commute_w:f pct_poverty_w:f "
    "vuln_score_0_100:f",
    "SELECT * FROM b_vuln",
)
def _vulnerability(m: Model):
    return m.vulnerability


@register(
    "priority_hotspots",
    "stop_id:s vuln_score_0_100:f crash_score_0_100:f reliability_score_0_100:f "
    "priority_score:f priority_rank:i",
    "SELECT * FROM b_hotspots",
)
def _priority_hotspots(m: Model):
    return m.hotspots


# -- lookups ----------------------------------------------------------------------------


@register(
    "route_lookup",
    "route_id:s route_name:s route_long_name:s route_type:s",
    """SELECT route_id, coalesce(nullif(route_short_name, ''), route_long_name) AS route_name,
              route_long_name, route_type FROM v_routes""",
)
def _route_lookup(m: Model):
    return lookups.gtfs_routes(m.routes)


@register(
    "stop_lookup",
    "stop_id:s stop_name:s lat:f lon:f",
    "SELECT stop_id, stop_name, stop_lat AS lat, stop_lon AS lon FROM v_stops",
)
def _stop_lookup(m: Model):
    return lookups.gtfs_stops(m.stops)
