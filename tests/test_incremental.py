"""Daily state: what an update reads, and reports equal to fresh ones."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import replace
from pathlib import Path

import pytest

from tests.conftest import CUTOVER
from cutpoint import Workload
from cutpoint.plans import reports, staging
from cutpoint.plans.incremental import DailyState
from cutpoint.plans.performance import queue_daily
from cutpoint.session import new_table_path
from cutpoint.sources.schema import QUERY_HISTORY, read_staged
from cutpoint.sources.snapshots import Snapshots


def on(*days):
    return [CUTOVER + dt.timedelta(days=d) for d in days]


class Kept:
    def __init__(self, spark, facts, **config):
        self.spark, self.facts = spark, facts
        self.path, self.runs = new_table_path(spark, "state"), new_table_path(spark, "runs")
        self.cfg = facts.workload(**config).cfg

    @property
    def state(self):
        return DailyState(self.spark, self.path, self.runs, self.cfg)

    def load(self, day, **more):
        """Everything before ``day`` is staged."""
        as_of = CUTOVER + dt.timedelta(days=day)
        staging.append_query_history(self.facts.sources()[0], self.runs, self.cfg, as_of, **more)

    def same(self, *names):
        """Reports of the state equal those of the facts."""
        meters = staging.stage_metering_rows(self.facts.sources()[1], self.cfg)
        fresh = Workload(read_staged(self.spark, self.runs, QUERY_HISTORY), meters, self.cfg, share=True)
        for report in [*(reports.REPORTS[n] for n in names), queue_daily]:
            got, want = report(self.state.workload(meters)), report(fresh)
            got, want = (sorted(map(repr, df.drop("last_updated").collect())) for df in (got, want))
            assert got == want and want


def test_an_appended_day_reads_that_day_and_those_of_changed_patterns(spark, steady):
    steady.run(-9, pattern="rare")
    steady.run(-4, pattern="rare")
    steady.run(2, pattern="rare")
    kept = Kept(spark, steady)
    kept.load(2)
    first = kept.state.update()
    assert first.counted == first.rebuilt == on(*range(-30, 2))
    assert kept.state.update() == type(first)([], [])
    kept.load(3)
    # All other days are made unreadable, without the listing telling.
    hidden = {}
    for day in on(*(d for d in range(-30, 2) if d not in (-9, -4))):
        for file in Path(kept.runs.removeprefix("file:"), f"activity_date={day}").glob("part-*.parquet"):
            seen, hidden[file] = file.stat(), file.read_bytes()
            file.write_bytes(b"x" * len(hidden[file]))
            os.utime(file, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    assert len(hidden) >= 30
    found = kept.state.update()
    assert found.counted == on(2) and found.rebuilt == on(-9, -4, 2)
    meters = staging.stage_metering_rows(steady.sources()[1], kept.cfg)
    assert reports.REPORTS["migration_decision"](kept.state.workload(meters)).count() == 1
    for file, content in hidden.items():
        file.write_bytes(content)
    kept.same("migration_decision", "perf_daily", "perf_by_dow")


def test_late_rows_are_found_by_the_listing(spark, steady):
    kept = Kept(spark, steady)
    kept.load(20)
    kept.state.update()
    steady.run(17, 99_000, "p1")
    kept.load(20, overlap_days=5)
    assert kept.state.update().counted == on(17)
    kept.same("perf_daily")


def test_another_window_and_cutover(spark, steady):
    kept = Kept(spark, steady, lookback_days=10, lookahead_days=5)
    kept.load(25)
    assert kept.state.update().counted == on(*range(-10, 6))
    kept.cfg = replace(kept.cfg, lookback_days=12, lookahead_days=9)
    with pytest.raises(ValueError):
        kept.state.workload(None)
    assert kept.state.update().counted == on(-12, -11, 6, 7, 8, 9)
    kept.same("perf_daily")
    kept.cfg = replace(kept.cfg, cutover=CUTOVER + dt.timedelta(days=3))
    found = kept.state.update()
    assert found.counted == on(10, 11, 12) and found.rebuilt == on(10, 11, 12)
    kept.same("perf_daily")


def test_per_key_with_null_and_patterns_that_leave(spark, facts):
    for day in range(-6, 6):
        for who in (None, "u"):
            facts.run(day, 1000 + day * 10, "p", user_name=who)
            facts.meter(day, "1")
    facts.run(-6, pattern="leaves", user_name=None)
    facts.run(3, pattern="leaves", user_name=None)
    kept = Kept(spark, facts, keys=("user_name",), lookback_days=6, lookahead_days=5)
    kept.load(6)
    kept.state.update()
    # The window no longer holds the pattern's only day before the change.
    kept.cfg = replace(kept.cfg, lookback_days=5)
    assert kept.state.update().rebuilt == on(3)
    meters = staging.stage_metering_rows(facts.sources()[1], kept.cfg).selectExpr("*", "CAST(NULL AS STRING) AS user_name")
    fresh = Workload(read_staged(spark, kept.runs, QUERY_HISTORY), meters, kept.cfg, share=True)
    got, want = (sorted(map(repr, reports.REPORTS["perf_daily"](w).collect())) for w in (kept.state.workload(meters), fresh))
    assert got == want and len(want) == 22
    kept.cfg = replace(kept.cfg, keys=())
    with pytest.raises(ValueError):
        kept.state.update()


def test_an_update_that_dies_between_its_commits(spark, steady, monkeypatch):
    kept = Kept(spark, steady)
    kept.load(2)
    kept.state.update()
    kept.load(3)
    commits = []

    def once(self, *args, commit=Snapshots.commit):
        commits.append(args)
        if len(commits) > 1:
            raise KeyboardInterrupt
        return commit(self, *args)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Snapshots, "commit", once)
        kept.state.update()
    found = kept.state.update()
    assert found.counted == [] and found.rebuilt == on(2)
    kept.same("perf_daily")


def test_state_whose_earlier_counts_were_expired_is_made_anew(spark, steady):
    kept = Kept(spark, steady, lookback_days=4, lookahead_days=4)
    for day in (1, 2):
        kept.load(day)
        kept.state._counted(staging_days(kept))
    kept.state.update()
    kept.load(3)
    kept.state._counted(staging_days(kept))
    kept.state.counts.expire(keep=1)
    assert kept.state.update().rebuilt == on(*range(-4, 3))


def staging_days(kept):
    from cutpoint.sources.folders import day_signatures

    return {d: s for d, s in day_signatures(kept.spark, kept.runs).items() if kept.cfg.first_day <= d <= kept.cfg.last_day}
