"""Reports on small hand-made facts: scopes, NULL logic, empty periods."""

import datetime as dt

import pytest

from cutpoint import Config, Tuning, Workload
from cutpoint.functions import labels as L
from cutpoint.plans import staging
from cutpoint.plans.cost import cost_by_dow, cost_daily, cost_welch_test, daily_trend
from cutpoint.plans.decision import migration_decision
from cutpoint.plans.performance import perf_by_dow, perf_daily, perf_summary, perf_welch_test
from cutpoint.plans.regressions import pattern_regressions, top_patterns
from cutpoint.plans.reliability import error_analysis, reliability
from cutpoint.plans.reports import REPORTS, create_views
from cutpoint.plans.validation import data_validation
from cutpoint.session import new_table_path
from cutpoint.sources.schema import METERING, QUERY_HISTORY, read_staged
from tests.conftest import CUTOVER


def day(n):
    return CUTOVER + dt.timedelta(days=n)


def by_day(df):
    return {r["activity_date"]: r for r in df.collect()}


def one(df):
    (row,) = df.collect()
    return row


def test_report_columns(steady):
    """Column counts of the thirteen reports."""
    w = steady.workload(share=True)
    counts = {
        "data_validation": 15,
        "perf_daily": 12,
        "perf_welch_test": 15,
        "perf_by_dow": 28,
        "perf_summary": 24,
        "cost_daily": 9,
        "cost_welch_test": 40,
        "cost_by_dow": 19,
        "reliability": 17,
        "error_analysis": 17,
        "pattern_regressions": 16,
        "daily_trend": 12,
        "migration_decision": 37,
    }
    assert {n: len(report(w).columns) for n, report in REPORTS.items()} == counts


def test_shared_workload_gives_the_same_reports(steady):
    alone, shared = steady.workload(), steady.workload(share=True)
    for name, report in REPORTS.items():
        a, b = report(alone), report(shared)
        keep = [c for c in a.columns if c != "last_updated"]
        got, want = (sorted(x.select(keep).collect(), key=str) for x in (a, b))
        assert got == want, name


def test_views(spark, steady):
    names = create_views(steady.workload(share=True), "t_")
    assert len(names) == 13
    assert spark.sql("SELECT assessment FROM t_migration_decision").count() == 1


def test_views_outlive_a_load(spark, steady):
    paths = [new_table_path(spark, n) for n in ("qh", "wh")]
    cfg = Config(cutover=CUTOVER, lookback_days=30, lookahead_days=29)

    def load(n: int):
        runs, meters = steady.sources()
        staging.append_query_history(runs, paths[0], cfg, CUTOVER + dt.timedelta(days=n))
        staging.reload_metering(meters, paths[1], cfg, CUTOVER + dt.timedelta(days=n))
        tables = read_staged(spark, paths[0], QUERY_HISTORY), read_staged(spark, paths[1], METERING)
        return Workload(*tables, cfg, share=True)

    create_views(load(20), "s_")
    before = spark.table("s_cost_daily").collect()
    fresh = load(25)
    assert spark.table("s_cost_daily").collect() == before
    create_views(fresh, "s_")
    assert spark.table("s_cost_daily").count() == len(before) + 5


def test_perf_daily_scope(facts):
    for ms in (1000, 2000, 3000):
        facts.run(-1, ms)
        facts.run(1, ms)
    facts.run(-1, 50_000, status="FAIL")
    facts.run(-1, 60_000, status=None)
    facts.run(-1, 70_000, bytes=0)
    facts.run(-1, 80_000, bytes=None)
    facts.run(-1, 90_000, "only before")
    facts.run(-1, 90_000, None)
    facts.run(-2, 5000, status="FAIL")  # no success: the day is left out
    found = by_day(perf_daily(facts.workload()))
    assert set(found) == {day(-1), day(1)}
    before = found[day(-1)]
    assert before["query_count"] == 3
    assert (before["median_exec_sec"], before["p95_exec_sec"], before["p99_exec_sec"]) == (2.0, 2.9, 2.98)
    assert (before["p95_tail_count"], before["p95_tail_weight_pct"]) == (1, 50.0)
    assert before["success_rate_pct"] == 60.0  # of five live runs of matched patterns
    assert before["period_type"] == "GEN1" and found[day(1)]["period_type"] == "GEN2"


def test_tail_with_ties_and_single_runs(facts):
    facts.run(-1, 1000)
    for _ in range(10):
        facts.run(1, 1000)
    facts.run(2, None)
    found = by_day(perf_daily(facts.workload()))
    assert (found[day(-1)]["p95_tail_count"], found[day(-1)]["p95_tail_weight_pct"]) == (1, 100.0)
    assert found[day(1)]["p95_tail_count"] == 10
    unknown = found[day(2)]
    assert (unknown["query_count"], unknown["median_exec_sec"], unknown["p95_tail_count"]) == (1, None, 0)


def test_window_and_scope(facts):
    for n in (-31, -30, 29, 30):
        facts.run(n)
    facts.run(0, warehouse="ANALYTICSXA")  # the underscore of the pattern is a wildcard
    facts.run(0, warehouse="OTHER")
    facts.run(0, warehouse=None)
    assert {r["activity_date"] for r in facts.workload().query_days.collect()} == {day(-30), day(0), day(29)}
    found = by_day(facts.workload(scope_like="ALL").query_days)
    assert found[day(0)]["total_queries"] == 2


def test_cost_days(facts):
    for n in (-2, -1, 1, 2):
        facts.run(n)
    facts.run(-2, bytes=0)
    facts.run(-2, status="FAIL")
    facts.meter(-2, "1.5")
    facts.meter(-2, "0.5", hour=9)
    facts.meter(-3, "4")  # metered without runs
    facts.meter(1, "3")
    found = by_day(cost_daily(facts.workload()))
    assert set(found) == {day(-3), day(-2), day(1)}
    assert found[day(-2)]["daily_credits"] == 2.0
    assert (found[day(-2)]["all_query_count"], found[day(-2)]["pattern_query_count"]) == (2, 1)
    assert (found[day(-2)]["all_credits_per_query"], found[day(-2)]["wh_credits_per_pattern_query"]) == (1.0, 2.0)
    assert (found[day(-3)]["all_query_count"], found[day(-3)]["all_credits_per_query"]) == (0, None)
    trend = by_day(daily_trend(facts.workload()))
    assert trend[day(-3)]["day_of_week"] is None and trend[day(-3)]["perf_pattern_query_count"] is None
    assert trend[day(-2)]["day_of_week"] == "Sat"


def test_counting_reports_need_no_percentiles(steady):
    w = steady.workload()
    for report in (data_validation, cost_daily, cost_welch_test, cost_by_dow):
        assert "Window" not in report(w)._jdf.queryExecution().optimizedPlan().toString(), report.__name__
    assert "cells" not in vars(w) and "cells_with_queue" not in vars(w)


def test_mean_of_ratios_and_weighted_ratio(facts):
    """100 credits for 1000 queries and 50 for 100: 0.30 a day on average, 0.136 a query."""
    for n, runs, credits in ((-2, 1000, "100"), (-1, 100, "50"), (1, 1000, "100"), (2, 100, "50")):
        for _ in range(runs):
            facts.run(n)
        facts.meter(n, credits)
    row = one(cost_welch_test(facts.workload()))
    assert row["gen1_all_avg_credits_per_query"] == 0.3
    assert row["gen1_all_weighted_credits_per_query"] == 0.136364
    assert row["breakeven_status"] == L.COST_LOWER
    assert row["significance"] == "INSUFFICIENT DF"
    assert row["all_avg_cpq_ci_lower_90"] is None
    assert row["cost_metric_consistency"].startswith(L.DIVERGENCE_OK)


@pytest.mark.parametrize("present", [-1, 1])
def test_one_period_only(facts, present):
    for n in range(3):
        facts.run(present * (n + 1))
        facts.meter(present * (n + 1), "1")
    w = facts.workload()
    for report in (perf_summary, cost_welch_test, reliability, migration_decision, perf_by_dow, perf_welch_test):
        assert report(w).count() == 0
    row = one(data_validation(w))
    assert (row["query_days"], row["common_patterns"], row["pattern_coverage_pct"]) == (3, 0, 0.0)
    errors = error_analysis(w).collect()
    assert errors == []


def test_no_rows_at_all(facts):
    facts.run(0, warehouse="OTHER")
    facts.meter(0, "1", warehouse="OTHER")
    w = facts.workload()
    for name, report in REPORTS.items():
        assert report(w).count() == 0, name


def test_error_analysis(facts):
    for n in (-2, -1, 1, 2):
        for _ in range(100):
            facts.run(n)
    facts.run(-1, status="FAIL")
    facts.run(-2, status="GONE")
    for n in (1, 2):
        facts.run(n, status="FAIL", query_text=f"failed on {n}")
        facts.run(n, status="FAIL", query_text="x" * 300)
    facts.run(2, status="INCIDENT")
    facts.run(2, status=None)
    found = {r["execution_status"]: r for r in error_analysis(facts.workload()).collect()}
    assert set(found) == {"FAIL", "INCIDENT"}
    fail = found["FAIL"]
    assert (fail["gen1_error_count"], fail["gen2_error_count"], fail["error_trend"]) == (1, 4, L.RATE_DOUBLED)
    assert (fail["first_seen"], fail["last_seen"], fail["sample_query"]) == (day(1), day(2), "failed on 1")
    assert (fail["gen1_total_queries"], fail["gen2_total_queries"]) == (202, 206)
    assert found["INCIDENT"]["error_trend"] == L.NEW_ERROR


def test_errors_without_a_baseline(facts):
    facts.run(1, status="FAIL")
    row = one(error_analysis(facts.workload()))
    assert (row["gen1_total_queries"], row["gen1_errors_per_1000_queries"]) == (0, None)
    assert row["error_trend"] == L.NEW_ERROR


def test_pattern_regressions(facts):
    for n, factor in ((-1, 1), (1, 2)):
        for i in range(10):
            facts.run(n, 1000, "same")
            facts.run(n, 1000 * factor, "slower", warehouse=f"ANALYTICS_{i % 2}")
            facts.run(n, 4000 // factor, "faster")
        for i in range(9):
            facts.run(n, 1000 * factor, "rare")
    facts.run(-3, 1000, "slower", query_text="first text")
    rows = pattern_regressions(facts.workload()).collect()
    assert [r["pattern_hash"] for r in rows] == ["faster", "slower", "same"]
    assert [r["status"] for r in rows] == [L.IMPROVEMENT, L.REGRESSION, L.STABLE]
    assert [r["impact_score"] for r in rows] == [20.0, 10.0, 0.0]
    slower = rows[1]
    assert (slower["gen1_count"], slower["gen2_count"]) == (11, 10)
    assert (slower["sample_query"], slower["sample_warehouse"]) == ("first text", "ANALYTICS_A")
    top = top_patterns(facts.workload(), L.REGRESSION, 1).collect()
    assert top == [slower]


@pytest.mark.parametrize("tuning", [Tuning(), Tuning(broadcast_max_rows=0)])
def test_pattern_regressions_keep_a_null_key(facts, tuning):
    for n, factor in ((-1, 1), (1, 2)):
        for user in (None, "u"):
            for _ in range(10):
                facts.run(n, 1000 * factor, "slower", user_name=user)
    w = facts.workload(keys=("user_name",), tuning=tuning)
    columns = ("user_name", "gen1_count", "gen2_count", "gen1_median_sec", "gen2_median_sec", "status", "sample_query")
    want = [(user, 10, 10, 1.0, 2.0, L.REGRESSION, "text slower") for user in (None, "u")]
    assert [tuple(r[c] for c in columns) for r in pattern_regressions(w).collect()] == want
    top = top_patterns(w, L.REGRESSION).collect()
    assert sorted((tuple(r[c] for c in columns) for r in top), key=str) == sorted(want, key=str)


def test_weekday_success_rate_is_always_100(steady):
    rows = perf_by_dow(steady.workload()).collect()
    assert len(rows) == 7
    assert {r["gen1_success_rate_pct"] for r in rows} == {100.0}


def test_weekday_test_needs_four_days(steady):
    assert perf_welch_test(steady.workload(lookahead_days=20)).count() == 0
    assert perf_welch_test(steady.workload()).count() == 7


def test_keys_equal_separate_runs(facts):
    for n in range(-20, 20):
        for name, base in (("ANALYTICS_A", 1000), ("ANALYTICS_B", 5000)):
            for i in range(6):
                facts.run(n, base + (n * 37 + i * 101) % 400, f"p{i % 2}", warehouse=name,
                          status="FAIL" if (n + i) % 9 == 0 else "SUCCESS")
            facts.meter(n, "2.5" if n < 0 else "3", warehouse=name)
    keyed = facts.workload(keys=("warehouse_name",), share=True)
    for name, report in REPORTS.items():
        together = report(keyed)
        shown = [c for c in together.columns if c not in ("warehouse_name", "last_updated", "domain_pattern")]
        for warehouse in ("ANALYTICS_A", "ANALYTICS_B"):
            alone = report(facts.workload(scope_like=warehouse))
            got = together.where(f"warehouse_name = '{warehouse}'").select(shown).collect()
            assert sorted(got, key=str) == sorted(alone.select(shown).collect(), key=str), name


def test_missing_period_for_one_key(facts):
    for n in range(-10, 10):
        facts.run(n)
        facts.meter(n, "1")
        if n < 0:
            facts.run(n, warehouse="ANALYTICS_B")
            facts.meter(n, "1", warehouse="ANALYTICS_B")
    rows = migration_decision(facts.workload(keys=("warehouse_name",))).collect()
    assert [r["warehouse_name"] for r in rows] == ["ANALYTICS_A"]
