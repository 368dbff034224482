"""What a panel looks like: its key, its clock, its column groups and its limits.

Every operator takes a :class:`PanelSpec`, so no column name is built into the
operators.  ``AIR_QUALITY`` is the preset the registered queries use.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Results depend on these names, orders and limits.
POLLUTANTS = (
    "pm10",
    "pm2_5",
    "carbon_monoxide",
    "nitrogen_dioxide",
    "sulphur_dioxide",
    "ozone",
)
WEATHER = ("temperature", "wind_speed")
CALENDAR = ("h_sin", "h_cos", "h2_sin", "h2_cos", "dow_sin", "dow_cos", "mon_sin", "mon_cos")
GEO_NAMES = ("latitude", "longitude", "lat", "lon", "lng")
HORIZONS = (24, 72, 168)
WINDOW_ROWS = 48
GAP_LIMIT = 6
SIGMA_FLOOR = 1e-8
MIN_EXTRA_ROWS = 100


class PanelValidationError(ValueError):
    """A panel breaks a schema or structure rule."""


class HorizonUnavailableError(ValueError):
    """The horizon is not offered, or too few future rows exist for it."""


class ArtifactMissingError(FileNotFoundError):
    """A stored model is not where it should be."""


@dataclass(frozen=True)
class PanelSpec:
    """Column roles and limits of a panel holding many series.

    ``time`` columns are ``timestamp_ntz`` holding UTC wall-clock time, so no
    result depends on the session time zone.  ``block_rows`` bounds how many
    clock ticks of one series a single task handles: a series of any length is
    cut into blocks of that many ticks, and what must cross a block edge goes
    through one summary row per block.
    """

    key: str = "series_id"
    time: str = "time"
    targets: tuple[str, ...] = POLLUTANTS
    drivers: tuple[str, ...] = WEATHER
    calendar: tuple[str, ...] = CALENDAR
    cadence_seconds: int = 3600
    window: int = WINDOW_ROWS
    horizons: tuple[int, ...] = HORIZONS
    gap_limit: int = GAP_LIMIT
    block_rows: int = 4096

    @property
    def measured(self) -> tuple[str, ...]:
        return self.targets + self.drivers

    @property
    def features(self) -> tuple[str, ...]:
        return self.targets + self.drivers + self.calendar

    @property
    def required_past(self) -> tuple[str, ...]:
        return (self.time, *self.measured)

    @property
    def required_future(self) -> tuple[str, ...]:
        return (self.time, *self.drivers)

    def daily(self) -> "PanelSpec":
        return replace(self, cadence_seconds=86400)

    def but(self, **changes) -> "PanelSpec":
        return replace(self, **changes)


AIR_QUALITY = PanelSpec()
