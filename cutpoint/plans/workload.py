"""The two fact tables with one configuration, and the shared tables that reports are made of."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from cutpoint.config import Config
from cutpoint.operators.cells import workload_cells, workload_counts
from cutpoint.operators.daily import daily_counts, daily_metering, daily_queries, with_calendar, with_cost
from cutpoint.operators.patterns import mark_matched, matched_only, pattern_presence
from cutpoint.operators.scope import PATTERN, in_scope, in_window
from cutpoint.session import settle


class Workload:
    """Staged facts under comparison.

    Two narrow passes over the query history feed a daily report: one counts pattern runs per
    period, one reduces the marked rows, to cells (``workload_cells``) for reports of times, to plain
    counts (``workload_counts``) for reports of volume and cost. All results are settled, so
    no later step and no lost executor reads the facts again; every later step works on tables that
    grow with days and distinct milliseconds, not with runs.

    With ``share`` the daily table is settled too and feeds every report: the way to ask for many
    reports of one workload. Without it each report computes only the columns it needs.

    A NULL in a key column of the configuration is a key of its own.
    """

    def __init__(
        self, query_history: DataFrame, metering: DataFrame, cfg: Config, *, share: bool = False
    ):
        self.query_history = query_history
        self.metering = metering
        self.cfg = cfg
        self.share = share

    @property
    def rows(self) -> DataFrame:
        """Query history in window and scope."""
        return self.query_history.where(f"{in_window(self.cfg)} AND {in_scope(self.cfg)}")

    @cached_property
    def presence(self) -> DataFrame:
        """Runs per pattern and period; counted once, when first needed."""
        return settle(pattern_presence(self.query_history, self.cfg))

    @property
    def matched_patterns(self) -> DataFrame:
        return matched_only(self.presence).selectExpr(*self.cfg.keys, f"{PATTERN} AS pattern_hash")

    @cached_property
    def marked_rows(self) -> DataFrame:
        """Rows with ``is_pattern``, cut down to the columns the cells need."""
        needed = [
            *[k for k in self.cfg.keys if k != "warehouse_name"],
            "warehouse_name",
            "activity_date",
            "start_time",
            PATTERN,
            "bytes_scanned",
            "execution_status",
            "execution_time",
            "queued_overload_time",
            "queued_provisioning_time",
            "queued_repair_time",
        ]
        return mark_matched(self.rows.select(*needed), self.presence, self.cfg)

    @cached_property
    def counts(self) -> DataFrame:
        return settle(workload_counts(self.marked_rows, self.cfg))

    @property
    def count_days(self) -> DataFrame:
        """Days with runs: counts only, no times."""
        return with_calendar(daily_counts(self.counts, self.cfg), self.cfg)

    @cached_property
    def cells(self) -> DataFrame:
        if self.share:
            return self.cells_with_queue
        return settle(workload_cells(self.marked_rows, self.cfg, with_queue=False))

    @cached_property
    def cells_with_queue(self) -> DataFrame:
        return settle(workload_cells(self.marked_rows, self.cfg, with_queue=True))

    @cached_property
    def query_days(self) -> DataFrame:
        """Days with runs: counts and execution percentiles."""
        if self.share:
            return self.all_days.where("total_queries IS NOT NULL")
        return with_calendar(daily_queries(self.cells, self.cfg, with_queue=False), self.cfg)

    @cached_property
    def queue_days(self) -> DataFrame:
        """As ``query_days``, plus queue times."""
        if self.share:
            return self.query_days
        queries = daily_queries(self.cells_with_queue, self.cfg, with_queue=True)
        return with_calendar(queries, self.cfg)

    @property
    def metering_days(self) -> DataFrame:
        return daily_metering(self.metering, self.cfg)

    @cached_property
    def cost_days(self) -> DataFrame:
        """Days with runs or metering: counts and cost, no times."""
        if self.share:
            return self.all_days
        queries = daily_counts(self.counts, self.cfg)
        return with_calendar(with_cost(queries, self.metering_days, self.cfg), self.cfg)

    @cached_property
    def trend_days(self) -> DataFrame:
        """Days with runs or metering: as ``query_days``, plus cost."""
        if self.share:
            return self.all_days
        queries = daily_queries(self.cells, self.cfg, with_queue=False)
        return with_calendar(with_cost(queries, self.metering_days, self.cfg), self.cfg)

    @cached_property
    def all_days(self) -> DataFrame:
        """Days with runs or metering, with all daily figures; settled, one row per day (and key)."""
        queries = daily_queries(self.cells_with_queue, self.cfg, with_queue=True)
        return settle(with_calendar(with_cost(queries, self.metering_days, self.cfg), self.cfg))
