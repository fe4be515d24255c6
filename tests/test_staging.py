import datetime as dt
import glob
import os

import pytest

from cutpoint.plans import staging
from cutpoint.session import new_table_path
from cutpoint.sources.schema import METERING, QUERY_HISTORY, read_staged
from tests.conftest import CUTOVER


def config(**more):
    from cutpoint import Config

    return Config(cutover=CUTOVER, **more)


def as_of(n):
    return CUTOVER + dt.timedelta(days=n)


def rows(spark, path, schema):
    df = read_staged(spark, path, schema).drop("last_inserted_at")
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def history(facts):
    for n in range(-40, 10):
        for i in range(5):
            facts.run(n, i, f"p{i}")
            facts.meter(n, f"{i}.25", hour=i)
    return facts


def test_full_refresh_scope(spark, history):
    history.run(0, warehouse="OTHER")
    history.run(0, warehouse=None)
    path = new_table_path(spark, "qh")
    staging.refresh_query_history(history.sources()[0], path, config(), as_of(5))
    days = {r["activity_date"] for r in read_staged(spark, path, QUERY_HISTORY).collect()}
    first = CUTOVER - dt.timedelta(days=30)
    assert min(days) == first - dt.timedelta(days=first.weekday())
    assert max(days) == as_of(4)
    assert {r["warehouse_name"] for r in read_staged(spark, path, QUERY_HISTORY).collect()} == {"ANALYTICS_A"}
    staging.refresh_query_history(history.sources()[0], path, config(lookback_days=0), as_of(2))
    days = {r["activity_date"] for r in read_staged(spark, path, QUERY_HISTORY).collect()}
    assert (min(days), max(days)) == (CUTOVER, as_of(1))


def test_incremental_equals_full(spark, history):
    runs, meters = history.sources()
    full = [new_table_path(spark, n) for n in ("qh", "wh")]
    step = [new_table_path(spark, n) for n in ("qh", "wh")]
    staging.refresh_query_history(runs, full[0], config(), as_of(9))
    staging.refresh_metering(meters, full[1], config(), as_of(9))
    for n in (-20, -19, 0, 9, 9):  # the last one is a rerun
        staging.append_query_history(runs, step[0], config(), as_of(n))
        staging.reload_metering(meters, step[1], config(), as_of(n))
    assert rows(spark, step[0], QUERY_HISTORY) == rows(spark, full[0], QUERY_HISTORY)
    assert rows(spark, step[1], METERING) == rows(spark, full[1], METERING)
    qh, wh = read_staged(spark, step[0], QUERY_HISTORY), read_staged(spark, step[1], METERING)
    found = {(r["source"], r["period_type"]): (r[2], r[3]) for r in staging.coverage(qh, wh, config()).collect()}
    assert found[("qh", "GEN2")] == found[("wh", "GEN2")] == (9, as_of(8))
    assert staging.high_water_mark(qh) == dt.datetime.combine(as_of(8), dt.time(8))


def test_revised_metering_is_replaced(spark, facts):
    path = new_table_path(spark, "wh")
    for hour, credits in ((1, "1"), (2, "2"), (23, "0.1")):
        facts.meter(0, credits, hour=hour)
    facts.meter(-1, "5")
    staging.reload_metering(facts.sources()[1], path, config(), as_of(1))
    facts.meters[2]["credits_used"] = "3"  # the last interval was not final
    facts.meters[0]["credits_used"] = "100"  # an earlier one is taken as final
    facts.meter(1, "7")
    for _ in range(2):
        staging.reload_metering(facts.sources()[1], path, config(), as_of(2))
        found = read_staged(spark, path, METERING).collect()
        assert sorted(float(r["credits_used"]) for r in found) == [1, 2, 3, 5, 7]


def test_withdrawn_day_is_emptied(spark, facts):
    path = new_table_path(spark, "wh")
    facts.meter(-1, "1", hour=5)
    facts.meter(0, "5", hour=0)
    staging.reload_metering(facts.sources()[1], path, config(), as_of(1))
    del facts.meters[1]  # the source withdraws the day of the mark
    facts.meter(1, "2", hour=3)
    for _ in range(2):
        staging.reload_metering(facts.sources()[1], path, config(), as_of(2))
        assert sorted(float(r["credits_used"]) for r in read_staged(spark, path, METERING).collect()) == [1, 2]


def test_mark_opens_the_last_days_only(spark, history):
    path = new_table_path(spark, "qh")
    staging.refresh_query_history(history.sources()[0], path, config(), as_of(9))
    staged = read_staged(spark, path, QUERY_HISTORY)
    assert staging.high_water_mark(staged, as_of(10)) == staging.high_water_mark(staged, as_of(400))
    assert staging.high_water_mark(staged.limit(0), as_of(10)) == staging.EPOCH


def test_a_source_must_have_what_the_reports_rest_on(facts):
    facts.run(0)
    facts.meter(0, "1")
    runs, meters = facts.sources()
    for source, stage, column in (
        (runs, staging.stage_query_rows, "bytes_scanned"),
        (meters, staging.stage_metering_rows, "credits_used"),
    ):
        with pytest.raises(ValueError, match=column):
            stage(source.drop(column), config(), as_of(1))
    staging.stage_query_rows(runs.drop("queued_repair_time"), config(), as_of(1)).collect()


def test_late_rows_need_the_overlap(spark, facts):
    for n in (-3, -2, -1):
        facts.run(n)
    plain, overlap = (new_table_path(spark, "qh") for _ in range(2))
    for path in (plain, overlap):
        staging.append_query_history(facts.sources()[0], path, config(), as_of(0))
    facts.run(-2, query_id="late")
    facts.run(0)
    source = facts.sources()[0]
    staging.append_query_history(source, plain, config(), as_of(1))
    staging.append_query_history(source, overlap, config(), as_of(1), overlap_days=2)
    staging.append_query_history(source, overlap, config(), as_of(1), overlap_days=2)
    ids = [sorted(r["query_id"] for r in read_staged(spark, p, QUERY_HISTORY).collect()) for p in (plain, overlap)]
    assert ids[0] == ["0", "1", "2", "4"]
    assert ids[1] == ["0", "1", "2", "4", "late"]


def test_times_are_utc_in_any_session(spark, facts):
    """An instant late on a New York evening belongs to the next UTC day."""
    facts.run(0)
    base = facts.sources()[0].drop("start_time", "end_time")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        instant = "TIMESTAMP_LTZ'2024-03-12 01:30:00+00:00'"
        source = base.selectExpr("*", f"{instant} AS start_time", f"{instant} AS end_time")
        (row,) = staging.stage_query_rows(source, config(), as_of(5)).collect()
        assert staging.stage_query_rows(source, config(), as_of(1)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row["start_time"] == dt.datetime(2024, 3, 12, 1, 30)
    assert row["activity_date"] == dt.date(2024, 3, 12)
    assert (row["day_num"], row["day_of_week"]) == (2, "Tue")
    assert (row["year_iso"], row["week_iso"]) == (2024, 11)
    assert row["week_start_date"] == dt.datetime(2024, 3, 11)


def test_the_hour_that_repeats_in_autumn_stays_two_hours(spark):
    from cutpoint.functions.dates import utc_wall_clock

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = " UNION ALL ".join(f"SELECT TIMESTAMP_LTZ'2024-11-03 0{h}:30:00+00:00' AS t" for h in (5, 6))
        df = spark.sql(rows)
        found = sorted(r[0] for r in df.selectExpr(utc_wall_clock(df, "t")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == [dt.datetime(2024, 11, 3, 5, 30), dt.datetime(2024, 11, 3, 6, 30)]


def test_a_large_day_is_split_over_files(spark):
    cfg = config()
    source = spark.range(200_000).selectExpr(
        "1L AS execution_time",
        "'SUCCESS' AS execution_status",
        "1L AS bytes_scanned",
        "CAST(id AS STRING) AS query_id",
        "'ANALYTICS_A' AS warehouse_name",
        "sha2(CAST(id AS STRING), 256) AS query_parameterized_hash",
        # nine tenths of the rows on one day
        f"TIMESTAMP_NTZ'{as_of(1)} 00:00:00' + make_interval(0, 0, 0, CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END)"
        " AS start_time",
        f"TIMESTAMP_NTZ'{as_of(1)} 00:00:00' AS end_time",
    )
    path = new_table_path(spark, "qh")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
    try:
        staging.refresh_query_history(source, path, cfg, as_of(5))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    folder = path.removeprefix("file:")
    assert len(glob.glob(os.path.join(folder, f"activity_date={as_of(1)}", "*.parquet"))) > 3
    assert read_staged(spark, path, QUERY_HISTORY).count() == 200_000


def test_staged_tables_prune_days_and_columns(spark, history):
    from cutpoint import Workload
    from cutpoint.plans.performance import perf_daily

    runs, meters = history.sources()
    paths = [new_table_path(spark, n) for n in ("qh", "wh")]
    staging.refresh_query_history(runs, paths[0], config(), as_of(9))
    staging.refresh_metering(meters, paths[1], config(), as_of(9))
    w = Workload(read_staged(spark, paths[0], QUERY_HISTORY), read_staged(spark, paths[1], METERING), config())
    plan = w.marked_rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(activity_date" in plan
    assert "query_text" not in plan.split("ReadSchema")[1]
    assert perf_daily(w).count() == 39


def test_empty_target_starts_at_the_first_week(spark, history):
    path = new_table_path(spark, "qh")
    staging.append_query_history(history.sources()[0], path, config(), as_of(1))
    days = [r["activity_date"] for r in read_staged(spark, path, QUERY_HISTORY).collect()]
    assert min(days) == config().staging_start
