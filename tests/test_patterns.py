import pytest

from cutpoint import Tuning
from cutpoint.operators.patterns import shuffle_plan
from cutpoint.operators.scope import PATTERN


def fill(facts):
    for day in (-3, -2, 1, 2):
        for i in range(40):
            facts.run(day, 100 + i, "hot")  # a third of all runs
            facts.run(day, 100 + i, f"cold{i}")
            facts.run(day, 5 + i, None)
        facts.run(day, 7, "old" if day < 0 else "new")
    for i in range(30):
        facts.run(-3, i, "hot but gone")
    facts.run(-3, 1, "outside", warehouse="OTHER")
    facts.run(2, 1, "outside", warehouse="OTHER")
    facts.run(-31, 1, "too early")
    facts.run(2, 1, "too early")
    facts.run(-30, 1, "edges", bytes=0)
    facts.run(29, 1, "edges", status="FAIL")


def marked(w):
    return sorted(
        ((r[PATTERN] or ""), str(r["activity_date"]), r["execution_time"], r["is_pattern"])
        for r in w.marked_rows.collect()
    )


def test_matched_patterns(facts):
    fill(facts)
    w = facts.workload()
    assert {r[0] for r in w.matched_patterns.collect()} == {"hot", "edges"} | {f"cold{i}" for i in range(40)}
    flags = {}
    for pattern, *_, flag in marked(w):
        flags.setdefault(pattern, set()).add(flag)
    assert flags[""] == {False}
    assert flags["hot"] == flags["cold1"] == flags["edges"] == {True}
    assert flags["old"] == flags["new"] == flags["too early"] == flags["hot but gone"] == {False}
    assert "outside" not in flags


@pytest.mark.parametrize("tuning", [Tuning(broadcast_max_rows=5), Tuning(broadcast_max_bytes=5)])
def test_shuffle_route_gives_the_same_rows(facts, tuning):
    fill(facts)
    assert marked(facts.workload(tuning=tuning)) == marked(facts.workload())


def test_shuffle_route_spreads_frequent_patterns(spark, facts):
    fill(facts)
    w = facts.workload(tuning=Tuning(broadcast_max_rows=0, shuffle_rows=60))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = w.marked_rows.selectExpr(PATTERN, "spark_partition_id() AS part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for pattern in ("hot", None):
        here = [r["part"] for r in parts if r[PATTERN] == pattern]
        share = max(here.count(p) for p in set(here)) / len(here)
        assert len(set(here)) > 2 and share < 0.6, (pattern, share)


def test_keys_match_within_the_key(facts):
    for day, name in ((-1, "ANALYTICS_A"), (1, "ANALYTICS_B"), (-1, "ANALYTICS_B")):
        facts.run(day, 1, "p", warehouse=name)
    for tuning in (Tuning(), Tuning(broadcast_max_rows=0)):
        w = facts.workload(keys=("warehouse_name",), tuning=tuning)
        flags = {(r["warehouse_name"], r["is_pattern"]) for r in w.marked_rows.collect()}
        assert flags == {("ANALYTICS_A", False), ("ANALYTICS_B", True)}


def measured(*runs, size=100):
    from collections import Counter, namedtuple

    Magnitude = namedtuple("Magnitude", "magnitude patterns runs matched bytes")
    bits = Counter(n.bit_length() for n in runs)
    found = [Magnitude(b, c, sum(n for n in runs if n.bit_length() == b), c, c * size) for b, c in bits.items()]
    return [{f: getattr(m, f) for f in m._fields} for m in found]


def test_partitions_follow_what_was_measured():
    limits = Tuning(shuffle_rows=1000, shuffle_bytes=1 << 20)
    assert shuffle_plan([], limits).partitions == 1
    assert shuffle_plan(measured(*[1] * 10), limits).partitions == 1
    few = [5000, 3000, *[10] * 200]
    plan = shuffle_plan(measured(*few), limits)
    assert plan.partitions == 10 and sum(n >= plan.frequent for n in few) == 2
    # Many patterns of the same magnitude: only those that fill a partition alone are spread.
    even = [900] * 50 + [1010] * 3
    plan = shuffle_plan(measured(*even), limits)
    assert plan.partitions == 49 and sum(n >= plan.frequent for n in even) <= plan.partitions
    assert shuffle_plan(measured(*[3] * 100, size=1 << 20), limits).partitions == 100


def test_measured_partitions_are_used(spark, facts):
    fill(facts)
    w = facts.workload(tuning=Tuning(broadcast_max_rows=0, shuffle_rows=50))
    runs = w.presence.selectExpr("sum(gen1_runs + gen2_runs)").first()[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert w.marked_rows.rdd.getNumPartitions() == -(-runs // 50)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
