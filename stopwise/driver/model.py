"""The plans wired to the derived inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopwise.driver.views import Inputs
from stopwise.plans import events, headways, places, reliability, schedule, staging
from stopwise.sinks.tables import materialize


class Model:
    """Lazy relations of one run; each property is a plan, nothing is computed here."""

    def __init__(self, inputs: Inputs) -> None:
        self.inputs = inputs
        self.params = inputs.params

    @cached_property
    def trips(self) -> DataFrame:
        i = self.inputs
        return staging.trips(i.v_trips, i.v_calendar, i.v_calendar_dates)

    @cached_property
    def service_dates(self) -> DataFrame:
        i = self.inputs
        first, last = schedule.expansion_window(self.params)
        return schedule.service_dates(i.v_calendar, i.v_calendar_dates, first, last)

    @cached_property
    def patterns(self) -> DataFrame:
        times = staging.stop_times(self.inputs.v_stop_times)
        return schedule.trip_patterns(self.trips, self.service_dates, times)

    @cached_property
    def scheduled(self) -> DataFrame:
        return schedule.scheduled_arrivals(self.patterns, self.params)

    @cached_property
    def merged(self) -> DataFrame:
        i = self.inputs
        return events.merge_feeds(
            events.recent(i.v_updates, self.params), events.recent(i.v_positions, self.params)
        )

    @cached_property
    def events(self) -> DataFrame:
        i = self.inputs
        return events.rt_events(
            i.v_updates, i.v_positions, self.trips, self.patterns, self.params
        )

    @cached_property
    def resolved(self) -> DataFrame:
        return events.resolve(self.events, self.params)

    @cached_property
    def observed(self) -> DataFrame:
        return headways.headways_observed(self.resolved, self.params)

    @cached_property
    def scheduled_headways(self) -> DataFrame:
        return headways.headways_scheduled(self.scheduled)

    @cached_property
    def nearest(self) -> DataFrame:
        return headways.nearest_schedule(self.observed, self.scheduled_headways, self.params)

    @cached_property
    def adherence(self) -> DataFrame:
        return headways.headway_adherence(self.observed, self.scheduled_headways, self.params)

    @cached_property
    def weather(self) -> DataFrame:
        stamped = self.inputs.v_weather.withColumns(
            {
                **{c: F.lit(None).cast("double") for c in ("snow_mm", "tmin_c", "tmax_c", "tavg_c")},
                "_ingested_at": F.lit(self.params.now),
            }
        )
        return staging.weather(stamped)

    @cached_property
    def weather_days(self) -> DataFrame:
        return reliability.weather_by_date(self.weather, self.params)

    @cached_property
    def route_day(self) -> DataFrame:
        return reliability.reliability_by_route_day(self.resolved, self.weather_days, self.params)

    @cached_property
    def route_day_exact(self) -> DataFrame:
        return reliability.reliability_by_route_day(
            self.resolved, self.weather_days, self.params, exact=True
        )

    @cached_property
    def stop_hour(self) -> DataFrame:
        return reliability.reliability_by_stop_hour(self.resolved, self.adherence, self.params)

    @cached_property
    def stop_hour_exact(self) -> DataFrame:
        return reliability.reliability_by_stop_hour(
            self.resolved, self.adherence, self.params, exact=True
        )

    @cached_property
    def impacts(self) -> DataFrame:
        return reliability.weather_impacts(self.route_day, self.params)

    @cached_property
    def stops(self) -> DataFrame:
        return staging.stops(self.inputs.v_stops)

    @cached_property
    def routes(self) -> DataFrame:
        return staging.routes(self.inputs.v_routes)

    @cached_property
    def crashes(self) -> DataFrame:
        return staging.crashes(self.inputs.v_crashes, self.params)

    @cached_property
    def crash_proximity(self) -> DataFrame:
        return places.crash_proximity_by_stop(self.stops, self.crashes, self.params)

    @cached_property
    def sidewalks(self) -> DataFrame:
        return staging.sidewalks(self.inputs.v_sidewalks)

    @cached_property
    def access(self) -> DataFrame:
        return places.access_score_by_stop(self.stops, self.sidewalks, self.params)

    @cached_property
    def tracts(self) -> DataFrame:
        return staging.tracts(self.inputs.v_tracts)

    @cached_property
    def demographics(self) -> DataFrame:
        raw = self.inputs.v_acs
        absent = [c for c in staging.ACS_COLUMNS if c not in raw.columns]
        return staging.demographics(
            raw.withColumns({c: F.lit(None).cast("long") for c in absent})
        )

    @cached_property
    def vulnerability(self) -> DataFrame:
        return places.vulnerability_by_stop(
            self.stops, self.tracts, self.demographics, self.params
        )

    @cached_property
    def hotspots(self) -> DataFrame:
        return places.priority_hotspots(
            materialize(self.vulnerability, "vulnerability"),
            materialize(self.crash_proximity, "crash-proximity"),
            self.stop_hour,
            self.params,
        )
