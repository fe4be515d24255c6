"""Effects that didn't happen: what changes, and what doesn't."""

from __future__ import annotations

from cutpoint.operators.counterfactual import Effect, with_effects
from cutpoint.plans.decision import migration_decision


def test_only_runs_after_the_cutover_change(spark, facts):
    for day in (-1, 0, 3):
        facts.run(day, 1001, queued_overload_time=None if day else 7)
        facts.meter(day, "1.5")
    facts.run(0, 500, status=None, query_id=None)
    w = with_effects(
        facts.workload(),
        {
            "none": Effect(),
            "all": Effect(times=50, credits=150, failing=100, waiting=100, wait_ms=10, days=3),
            "slow": Effect(slow=100, slow_times=300),
            "it's quoted": Effect(days=0),
        },
    )
    assert w.cfg.keys == ("scenario",)
    runs = w.query_history.selectExpr(
        "scenario", "datediff(activity_date, DATE'2024-03-11') AS d", "execution_time", "execution_status", "queued_overload_time",
        "query_id IS NULL AS unknown",
    )
    found: dict = {}
    for r in runs.collect():
        found.setdefault(r[0], []).append(tuple(r)[1:])
    plain = [(-1, 1001, "SUCCESS", None, False), (0, 500, None, None, True), (0, 1001, "SUCCESS", 7, False), (3, 1001, "SUCCESS", None, False)]
    assert sorted(found["none"], key=repr) == sorted(plain, key=repr)
    assert sorted(found["all"], key=repr) == sorted(
        [(-1, 1001, "SUCCESS", None, False), (0, 500 // 2, None, None, True), (0, 500, "FAIL", 17, False)], key=repr
    )
    assert sorted(r[1] for r in found["slow"]) == [500, 1001, 3003, 3003]
    assert found["it's quoted"] == plain[:1]
    credits = {(r[0], r[1]): str(r[2].normalize()) for r in w.metering.selectExpr(
        "scenario", "datediff(activity_date, DATE'2024-03-11')", "credits_used").collect()}
    assert credits["all", 0] == "2.25" and credits["all", -1] == "1.5" and ("all", 3) not in credits


def test_decisions_differ_by_effect(spark, steady):
    effects = {"none": Effect(), "good": Effect(times=55, credits=50), "failing": Effect(failing=40), "week": Effect(days=5)}
    w = with_effects(steady.workload(), effects)
    found = {r.scenario: r.assessment for r in migration_decision(w).collect()}
    assert found["good"] == "STRONGLY FAVORABLE" and found["week"] == "INSUFFICIENT DATA"
    assert found["failing"].startswith("UNFAVORABLE") and len(set(found.values())) == 4
    plain = migration_decision(steady.workload()).first()
    assert found["none"] == plain.assessment
