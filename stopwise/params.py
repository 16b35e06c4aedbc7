"""Tunable settings shared by the plans."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo


@dataclass(frozen=True)
class Params:
    """Defaults of the analytics; ``as_of=None`` means "now"."""

    # They define the published metrics.
    zone: str = "America/Denver"
    on_time_sec: int = 300
    headway_tol_ratio: float = 0.5
    sched_match_tol_sec: int = 1800
    weather_station: str | None = "USW00023062"
    weather_lookback_days: int = 30
    rt_lookback_days: int = 45
    rt_incremental_hours: int = 12
    schedule_lookback_days: int = 45
    schedule_lookahead_days: int = 30
    recompute_days: int = 3
    crash_window_days: int = 365
    crash_radius_m: float = 250.0
    crash_inner_radius_m: float = 100.0
    sidewalk_buffer_m: float = 200.0
    tract_catchment_m: float = 804.672
    hotspot_window_days: int = 35
    hotspot_weights: tuple[float, float, float] = (0.5, 0.3, 0.2)

    as_of: datetime | None = None

    @property
    def now(self) -> datetime:
        """The reference instant, zone-aware in UTC."""
        moment = self.as_of or datetime.now(UTC)
        return moment if moment.tzinfo else moment.replace(tzinfo=UTC)

    @property
    def today(self) -> date:
        """The local service date of the reference instant."""
        return self.now.astimezone(ZoneInfo(self.zone)).date()

    def days_ago(self, days: int) -> date:
        return self.today - timedelta(days=days)

    def days_ahead(self, days: int) -> date:
        return self.today + timedelta(days=days)
