"""What to compare: the change date, the windows around it, the scope and the thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

GEN1 = "GEN1"
GEN2 = "GEN2"
EVERYTHING = "ALL"


@dataclass(frozen=True)
class Thresholds:
    """Numeric limits of the reports. The defaults are the published ones (fixed values)."""

    min_days_per_weekday: int = 4
    min_pattern_runs: int = 10
    subsecond_median_sec: float = 1.0
    high_volume_per_day: float = 1000.0
    high_spend_credits_per_day: float = 50.0
    price_per_credit: float = 3.0
    reliability_drop_pp: float = 0.5
    reliability_failure_increase_pct: float = 25.0


@dataclass(frozen=True)
class Tuning:
    """Physical limits. They choose between plans, never between results."""

    # The matched-pattern set is broadcast only when it was counted and fits both limits.
    broadcast_max_rows: int = 1_000_000
    broadcast_max_bytes: int = 64 * 1024 * 1024
    # Beyond them it is joined by a shuffle: runs, and bytes of patterns, that a partition should hold.
    shuffle_rows: int = 4_000_000
    shuffle_bytes: int = 128 * 1024 * 1024
    # Values and files that a scan is told by name; more are found by joins.
    lookup_values: int = 64
    lookup_files: int = 1000


@dataclass(frozen=True)
class Config:
    """One before/after comparison.

    ``cutover`` is the first full UTC day after the change. ``scope_like`` is a LIKE pattern on
    ``warehouse_name`` (``ALL`` or None: every named warehouse). ``keys`` are extra grouping
    columns found in both fact tables, for example ``("warehouse_name",)``: every report is then
    worked out per key in the same job. The empty tuple compares the workload as a whole.
    ``first_run_samples``: sample texts are those of a group's first run (start time, then query id), whose row is
    found without reading texts. Otherwise they are the smallest text of the group's first day.
    """

    cutover: date
    scope_like: str | None = "ANALYTICS_%"
    lookback_days: int = 30
    lookahead_days: int = 29
    keys: tuple[str, ...] = ()
    first_run_samples: bool = False
    thresholds: Thresholds = field(default_factory=Thresholds)
    tuning: Tuning = field(default_factory=Tuning)

    def __post_init__(self) -> None:
        if self.lookback_days < 0 or self.lookahead_days < 0:
            raise ValueError("lookback_days and lookahead_days must not be negative")

    @property
    def first_day(self) -> date:
        return self.cutover - timedelta(days=self.lookback_days)

    @property
    def last_day(self) -> date:
        return self.cutover + timedelta(days=self.lookahead_days)

    @property
    def staging_start(self) -> date:
        """Monday of the week that holds the first day: staging loads whole ISO weeks."""
        return self.first_day - timedelta(days=self.first_day.weekday())

    @property
    def covers_everything(self) -> bool:
        return self.scope_like is None or self.scope_like == EVERYTHING


def utc_today(as_of: datetime | date | None = None) -> date:
    """The UTC day that is still incomplete at ``as_of`` (now when omitted)."""
    if as_of is None:
        return datetime.now(timezone.utc).date()
    if isinstance(as_of, datetime):
        return (as_of.astimezone(timezone.utc) if as_of.tzinfo else as_of).date()
    return as_of
