"""Days from listings, ownership of settled tables, keys of NULL."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest

from tests.conftest import CUTOVER
from cutpoint.plans import reports, staging
from cutpoint.session import new_table_path, settle, settling
from cutpoint.sources.folders import remove, staged_days
from cutpoint.sources.schema import METERING, read_staged


def loaded(facts, path_runs, path_meters, cfg, as_of):
    runs, meters = facts.sources()
    staging.append_query_history(runs, path_runs, cfg, as_of)
    staging.reload_metering(meters, path_meters, cfg, as_of)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_coverage_from_the_listing(spark, facts):
    for day in (-3, -2, 1):
        facts.run(day)
        facts.meter(day, "1.5")
    facts.meter(2, "2")
    paths = new_table_path(spark, "runs"), new_table_path(spark, "meters")
    cfg = facts.workload().cfg
    loaded(facts, *paths, cfg, CUTOVER + dt.timedelta(days=10))
    found = staging.coverage_of(spark, *paths, cfg)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "FileScan" not in plan
    tables = (read_staged(spark, p, s) for p, s in zip(paths, (staging.QUERY_HISTORY, METERING)))
    assert rows(found) == rows(staging.coverage(*tables, cfg)) and found.count() == 4
    assert staged_days(spark, paths[0]) == [CUTOVER + dt.timedelta(days=d) for d in (-3, -2, 1)]


def test_the_mark_opens_the_latest_day_only(spark, facts):
    for day in (-3, 1):
        facts.meter(day, "1")
    path, cfg = new_table_path(spark, "meters"), facts.workload().cfg
    assert staging.latest_mark(spark, path, METERING) == staging.EPOCH and staged_days(spark, path) == []
    staging.reload_metering(facts.sources()[1], path, cfg, CUTOVER + dt.timedelta(days=10))
    # Earlier days are unreadable, and neither a day without files nor a hidden file counts.
    folder = Path(path.removeprefix("file:"))
    early = folder / f"activity_date={CUTOVER - dt.timedelta(days=3)}"
    for file in early.glob("*.parquet"):
        file.write_bytes(b"not parquet")
    (folder / f"activity_date={CUTOVER + dt.timedelta(days=4)}").mkdir()
    hidden = folder / f"activity_date={CUTOVER + dt.timedelta(days=5)}"
    hidden.mkdir()
    (hidden / "_part.parquet").write_bytes(b"x")
    assert staging.latest_mark(spark, path, METERING) == dt.datetime.combine(CUTOVER + dt.timedelta(days=1), dt.time(8))


def test_a_withdrawn_day_leaves_the_listing(spark, facts):
    for day in (1, 2):
        facts.meter(day, "1")
    path, cfg = new_table_path(spark, "meters"), facts.workload().cfg
    as_of = CUTOVER + dt.timedelta(days=10)
    staging.reload_metering(facts.sources()[1], path, cfg, as_of)
    facts.meters.pop()
    staging.reload_metering(facts.sources()[1], path, cfg, as_of)
    assert staged_days(spark, path) == [CUTOVER + dt.timedelta(days=1)]
    remove(spark, path)
    remove(spark, path)
    assert staged_days(spark, path) == []


def test_settled_tables_go_with_their_owner(spark):
    df = spark.range(5)
    with settling(spark) as tables:
        kept = settle(df)
        with settling(spark) as inner:
            settle(df)
        assert kept.count() == 5 and inner.paths == []
        (path,) = tables.paths
        reader = tables.hold()
    assert Path(path.removeprefix("file:")).exists() and kept.count() == 5
    reader.close()
    assert not Path(path.removeprefix("file:")).exists()
    reader.close()
    with pytest.raises(ValueError):
        reader.hold()
    assert settle(df).count() == 5


def test_settled_tables_go_when_the_work_fails(spark):
    with pytest.raises(ZeroDivisionError), settling(spark) as tables:
        settle(spark.range(3))
        path = Path(tables.paths[0].removeprefix("file:"))
        assert path.exists()
        raise ZeroDivisionError
    assert not path.exists()


def test_views_stay_readable_until_their_reader_closes(spark, steady):
    with settling(spark) as tables:
        views = tables.hold()
        names = reports.create_views(steady.workload(share=True), "held_")
    assert spark.table(names[0]).count() > 0
    views.close()
    assert not [p for p in tables.paths if Path(p.removeprefix("file:")).exists()]


@pytest.mark.parametrize("report", ["perf_daily", "perf_by_dow", "cost_daily", "data_validation", "error_analysis", "daily_trend"])
def test_a_key_of_null_is_a_key(spark, steady, report):
    """One warehouse under a NULL user has the report of the workload without keys."""
    plain = steady.workload()
    keyed = steady.workload(keys=("user_name",))
    keyed.metering = keyed.metering.selectExpr("*", "CAST(NULL AS STRING) AS user_name")
    got, want = (reports.REPORTS[report](w) for w in (keyed, plain))
    assert got.where("user_name IS NOT NULL").count() == 0
    assert rows(got.drop("user_name").select(*want.columns)) == rows(want) and want.count() > 0
