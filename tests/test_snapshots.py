"""Loads that are seen whole or not at all."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest

from tests.conftest import CUTOVER
from cutpoint.plans import staging
from cutpoint.session import new_table_path
from cutpoint.sources.schema import METERING
from cutpoint.sources.snapshots import Conflict, Snapshots

AS_OF = CUTOVER + dt.timedelta(days=10)
SHOWN = ["activity_date", "start_time", "warehouse_name", "credits_used"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*SHOWN).collect())


def load(facts, path):
    return staging.replace_metering(facts.sources()[1], path, facts.workload().cfg, AS_OF)


def test_same_as_the_reload(spark, facts):
    """The tail is revised, a day is withdrawn and days are added, as in the table that is rewritten in place."""
    plain, path = new_table_path(spark, "plain"), new_table_path(spark, "snapshots")
    loads = [
        [(1, "1", 8), (2, "2", 8), (3, "0.5", 8), (3, "0.7", 9)],
        [(1, "1", 8), (2, "2", 8), (3, "0.5", 8), (3, "0.9", 9), (4, "4", 7)],
        [(1, "1", 8), (2, "2", 8), (3, "0.5", 8), (3, "0.9", 9)],
        [(1, "1", 8), (2, "2", 8), (3, "0.5", 8), (5, "5", 8)],
    ]
    for made in loads:
        facts.meters.clear()
        for day, credits, hour in made:
            facts.meter(day, credits, hour=hour)
        load(facts, path)
        staging.reload_metering(facts.sources()[1], plain, facts.workload().cfg, AS_OF)
        want = rows(staging.read_staged(spark, plain, METERING))
        assert rows(Snapshots(spark, path).read(METERING)) == want and want
    assert Snapshots(spark, path).current().version == len(loads)


def test_a_load_that_dies_changes_nothing(spark, facts, monkeypatch):
    path = new_table_path(spark, "snapshots")
    facts.meter(1, "1")
    facts.meter(2, "2")
    load(facts, path)
    before = rows(Snapshots(spark, path).read(METERING))
    facts.meters.pop()
    facts.meter(3, "3")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(Snapshots, "commit", killed)
        load(facts, path)
    # The new files are there, but nobody sees them.
    assert len(list(Path(path.removeprefix("file:"), "data").iterdir())) == 2
    assert rows(Snapshots(spark, path).read(METERING)) == before
    load(facts, path)
    assert [r[0] for r in rows(Snapshots(spark, path).read(METERING))] == [CUTOVER + dt.timedelta(days=d) for d in (1, 3)]


def test_of_two_loads_one_is_refused(spark, facts):
    path = new_table_path(spark, "snapshots")
    facts.meter(1, "1")
    load(facts, path)
    table = Snapshots(spark, path)
    before = table.current()
    load(facts, path)
    with pytest.raises(Conflict):
        table.commit(before, {})
    assert table.current().version == 2 and len(rows(table.read(METERING))) == 1
    assert not [p for p in Path(path.removeprefix("file:"), "_manifests").iterdir() if p.suffix != ".json" and p.suffix != ".crc"]


def test_readers_of_a_version_and_expiry(spark, facts):
    path = new_table_path(spark, "snapshots")
    table = Snapshots(spark, path)
    assert table.current().version == 0 and table.read(METERING).count() == 0
    table.expire()
    facts.meter(1, "1")
    first = load(facts, path)
    facts.meter(2, "2")
    load(facts, path)
    facts.meter(3, "3")
    load(facts, path)
    old = table.read(METERING, first)
    assert old.count() == 1
    # The day of the mark was written again, so the first load is named by the first manifest only.
    table.expire(keep=1)
    assert table.versions() == [3] and len(rows(table.read(METERING))) == 3
    assert len(list(Path(path.removeprefix("file:"), "data").iterdir())) == len(set(table.current().days.values()))


def test_an_empty_source(spark, facts):
    path = new_table_path(spark, "snapshots")
    load(facts, path)
    assert Snapshots(spark, path).read(METERING).count() == 0
    facts.meter(1, "1")
    load(facts, path)
    assert Snapshots(spark, path).read(METERING).count() == 1
