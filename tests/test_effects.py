"""Known effects put into the second period must come out of the decision."""

import pytest

from cutpoint.functions import labels as L
from cutpoint.plans.decision import migration_decision
from cutpoint.plans.performance import perf_summary
from cutpoint.plans.reliability import reliability


def changed(steady, *, time=1.0, credits=1.0, fail_every=0, wait=0):
    import datetime as dt
    import decimal

    from tests.conftest import CUTOVER

    cutover = dt.datetime.combine(CUTOVER, dt.time())
    for i, run in enumerate(steady.runs):
        if run["start_time"] >= cutover:
            run["execution_time"] = int(run["execution_time"] * time)
            run["queued_overload_time"] = wait
            if fail_every and i % fail_every == 0:
                run["execution_status"] = "FAIL"
    for meter in steady.meters:
        if meter["start_time"] >= cutover:
            meter["credits_used"] = str(decimal.Decimal(meter["credits_used"]) * decimal.Decimal(str(credits)))
    return steady


def decision(facts):
    (row,) = migration_decision(facts.workload()).collect()
    return row


def test_half_the_time_for_less(steady):
    row = decision(changed(steady, time=0.5, credits=0.9))
    assert 45 < row["speedup_lower_bound"] < row["speedup_pct"] < row["speedup_upper_bound"] < 55
    assert row["perf_significance"] == "SIGNIFICANT (p<0.05)"
    assert row["cost_change_upper_bound"] < 0
    # 20 runs a day of about a second: below a second the percentage says little.
    assert row["assessment"] == (
        L.INCONCLUSIVE_SUBSECOND if row["gen2_daily_median_sec"] < 1 else L.STRONGLY_FAVORABLE
    )


@pytest.mark.parametrize(
    "change, expected",
    [
        ({"time": 0.6, "credits": 0.9}, L.STRONGLY_FAVORABLE),
        ({"credits": 0.9}, L.FAVORABLE_NEUTRAL),
        ({"time": 1.4, "credits": 0.9}, L.MIXED_SLOWER),
        ({"time": 0.6, "credits": 1.1}, L.FAVORABLE_OFFSET),
        ({"credits": 1.3}, L.UNFAVORABLE_COST),
        ({"time": 2.5}, L.MIXED_TAIL),
        ({"fail_every": 4}, L.UNFAVORABLE_RELIABILITY),
        ({"wait": 9000}, L.MIXED_QUEUE),
    ],
)
def test_assessments(steady, change, expected):
    assert decision(changed(steady, **change))["assessment"] == expected


def test_swapping_the_periods_turns_the_sign(steady):
    import datetime as dt

    from tests.conftest import CUTOVER, Facts

    changed(steady, time=0.8)
    mirror = Facts(steady.spark)
    cutover = dt.datetime.combine(CUTOVER, dt.time())

    def mirrored(t):
        # Day −1 becomes day 0, day 0 becomes day −1, and so on.
        days = (t.date() - CUTOVER).days
        return t + dt.timedelta(days=-1 - 2 * days)

    mirror.runs = [
        {**r, "start_time": mirrored(r["start_time"]), "end_time": cutover}
        for r in steady.runs
        if (r["start_time"].date() - CUTOVER).days >= -30
    ]
    mirror.meters = steady.meters
    ((a,), (b,)) = (perf_summary(f.workload()).collect() for f in (steady, mirror))
    assert a["t_statistic"] == -b["t_statistic"]
    assert a["degrees_of_freedom"] == b["degrees_of_freedom"]
    assert (a["gen1_daily_median_sec"], a["gen2_daily_median_sec"]) == (
        b["gen2_daily_median_sec"],
        b["gen1_daily_median_sec"],
    )


def test_scaling_all_times_keeps_the_speedup(steady):
    (a,) = perf_summary(steady.workload()).collect()
    for run in steady.runs:
        run["execution_time"] *= 10
    (b,) = perf_summary(steady.workload()).collect()
    assert (a["speedup_pct"], a["t_statistic"]) == (b["speedup_pct"], b["t_statistic"])


def test_reliability_uses_all_runs(facts):
    for day in range(-14, 14):
        for i in range(50):
            facts.run(day, 1, None, bytes=0, status="FAIL" if day >= 0 and i < 2 + day % 2 else "SUCCESS")
    (row,) = reliability(facts.workload()).collect()
    assert (row["gen1_success_rate"], row["gen2_success_rate"]) == (100.0, 95.0)
    assert row["failure_rate_change_pct"] is None
    assert row["reliability_status"] == L.DEGRADED
    assert "n/a" in row["reliability_explanation"]
