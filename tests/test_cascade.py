"""Every outcome of the assessment, on one-row signals."""

import pytest

from cutpoint.config import Thresholds
from cutpoint.functions import labels as L
from cutpoint.functions import welch as W
from cutpoint.plans.decision import assess

# Signals that lead to the last rule.
NEUTRAL = {
    "gen1_days": 30,
    "gen2_days": 30,
    "gen1_total_queries": 30000,
    "gen2_total_queries": 30000,
    "gen1_pattern_coverage_pct": 95.0,
    "gen2_pattern_coverage_pct": 95.0,
    "speedup_pct": 10.0,
    "speedup_lower_bound": 5.0,
    "speedup_upper_bound": 15.0,
    "perf_significance": W.NOT_SIGNIFICANT,
    "tail_latency_check": L.OK,
    "queue_saturation_check": L.OK,
    "gen1_daily_median_sec": 5.0,
    "gen2_daily_median_sec": 4.5,
    "cost_change_pct": 3.0,
    "cost_change_lower_bound": -2.0,
    "cost_change_upper_bound": 8.0,
    "cost_significance": W.NOT_SIGNIFICANT,
    "breakeven_status": L.COST_NEUTRAL,
    "gen2_daily_credits": 10.0,
    "pattern_cost_change_pct": 2.0,
    "reliability_status": L.NO_DEGRADATION,
}


def cost(low, point, high, **more):
    return {
        "cost_change_lower_bound": low,
        "cost_change_pct": point,
        "cost_change_upper_bound": high,
        **more,
    }


def speed(low, point, high, **more):
    return {"speedup_lower_bound": low, "speedup_pct": point, "speedup_upper_bound": high, **more}


UNKNOWN = cost(None, None, None) | speed(None, None, None)
SLOW_QUERIES = {"gen2_total_queries": 20000}
CASES = [
    ({"gen2_days": 6, "reliability_status": L.DEGRADED}, L.INSUFFICIENT_DATA),
    ({"reliability_status": L.DEGRADED, "tail_latency_check": L.TAIL_WARNING}, L.UNFAVORABLE_RELIABILITY),
    ({"reliability_status": L.MINOR_05}, L.MIXED_RELIABILITY),
    ({"reliability_status": L.MINOR_10}, L.MIXED_RELIABILITY),
    ({"tail_latency_check": L.TAIL_WARNING, "queue_saturation_check": L.QUEUE_WARNING}, L.MIXED_TAIL),
    ({"queue_saturation_check": L.QUEUE_WARNING, "gen2_days": 10}, L.MIXED_QUEUE),
    ({"gen2_days": 10} | cost(-20.0, -11.0, -5.0), L.EARLY_POSITIVE),
    ({"gen2_days": 10} | cost(10.0, 21.0, 30.0), L.EARLY_NEGATIVE),
    ({"gen2_days": 13}, L.NEED_14_DAYS),
    ({"gen2_days": 13} | UNKNOWN, L.NEED_14_DAYS),
    ({"gen2_daily_median_sec": 0.9} | SLOW_QUERIES, L.INCONCLUSIVE_SUBSECOND),
    ({"gen2_daily_median_sec": 0.9}, L.MIXED_REVIEW),
    (cost(-9.0, -5.0, 0.0) | speed(35.0, 40.0, 45.0), L.STRONGLY_FAVORABLE),
    (cost(-9.0, -5.0, 0.0) | speed(-30.0, -20.0, -10.0), L.FAVORABLE_NEUTRAL),
    (cost(-9.0, -5.0, 0.0) | speed(-40.0, -21.0, -10.0), L.MIXED_SLOWER),
    (cost(-9.0, -5.0, 0.0) | speed(None, None, None), L.MIXED_SLOWER),
    (cost(-9.0, 1.0, 5.0) | speed(26.0, 30.0, 34.0), L.FAVORABLE_NEAR_BREAKEVEN),
    (cost(1.0, 9.0, 15.0) | speed(35.0, 40.0, 45.0), L.FAVORABLE_OFFSET),
    (cost(6.0, 9.0, 12.0, gen2_daily_credits=51.0), L.MIXED_SPEND),
    (cost(-2.0, 3.0, 10.0, tail_latency_check=L.TAIL_IMPROVED) | speed(-5.0, 0.0, 5.0), L.FAVORABLE_TAIL),
    (cost(16.0, 20.0, 24.0) | speed(5.0, 19.0, 30.0), L.UNFAVORABLE_COST),
    (cost(11.0, 13.0, 16.0, cost_significance=W.SIGNIFICANT_10) | speed(5.0, 19.0, 30.0), L.UNFAVORABLE_CONFIRMED),
    (cost(6.0, 9.0, 16.0) | speed(5.0, 10.0, 19.0), L.UNFAVORABLE_NEITHER),
    ({}, L.MIXED_REVIEW),
    (UNKNOWN, L.MIXED_REVIEW),
]


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [{"id": i, **NEUTRAL, **changes} for i, (changes, _) in enumerate(CASES)]
    types = {int: "bigint", float: "double", str: "string"}
    schema = ", ".join(f"{k} {types[type(NEUTRAL.get(k, 0))]}" for k in rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    return {r["id"]: r for r in assess(df, Thresholds()).collect()}


def test_all_outcomes(assessed):
    assert [assessed[i]["assessment"] for i in range(len(CASES))] == [label for _, label in CASES]
    outcomes = {label for _, label in CASES}
    assert len(outcomes) == 20


def test_every_assessment_is_explained(assessed):
    for row in assessed.values():
        assert row["assessment_explanation"]
        assert row["reasoning"]
        assert row["data_quality_explanation"]
        assert row["pattern_coverage_assessment"].startswith(L.COVERAGE_HIGH)


def test_notes_in_reasoning(assessed):
    by_label = {CASES[i][1]: row for i, row in assessed.items()}
    assert "51 credits a day" in by_label[L.MIXED_SPEND]["reasoning"]
    assert "$5026" in by_label[L.MIXED_SPEND]["assessment_explanation"]
    assert "under a second" in by_label[L.INCONCLUSIVE_SUBSECOND]["reasoning"]
    assert "N/A" in by_label[L.MIXED_REVIEW]["reasoning"]
    assert by_label[L.INSUFFICIENT_DATA]["reasoning"] == "At least 7 days are needed, there are 6."
