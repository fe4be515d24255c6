import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cutpoint.operators.quantiles import exact_percentiles
from cutpoint.session import group_by

PERCENTS = [5, 50, 95, 99]


def brute_force(values, p):
    values = sorted(values)
    position = (len(values) - 1) * p
    lower, upper = values[position // 100], values[-(-position // 100)]
    below = [v for v in values if v < upper]
    return lower * 100 + (upper - lower) * (position % 100), len(below), sum(below)


def percentiles(spark, groups, few_groups, partitions=3):
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, ms bigint").repartition(partitions)
    hist = group_by(df, ["g", "ms"], ["count(1) AS n"])
    found = exact_percentiles(hist, ["g"], "ms", PERCENTS, few_groups=few_groups)
    return {r["g"]: r for r in found.collect()}


def check(found, groups):
    assert set(found) == {g for g, values in groups.items() if any(v is not None for v in values)}
    for g, row in found.items():
        values = [v for v in groups[g] if v is not None]
        assert (row["n_values"], row["sum_values"]) == (len(values), sum(values))
        for p in PERCENTS:
            assert (row[f"p{p}_x100"], row[f"below{p}_n"], row[f"below{p}_sum"]) == brute_force(values, p)


@pytest.mark.parametrize("few_groups", [True, False])
def test_shapes(spark, few_groups):
    groups = {
        "one": [7],
        "two": [0, 10_000],
        "ties": [5] * 50 + [6] * 50,
        "tie at the top": list(range(90)) + [500] * 10,
        "wide": [i * 977 % 1_000_003 for i in range(400)],
        "buckets edge": [999, 1000, 1001, 1999, 2000],
        "with null": [None, 3, None, 4],
        "only null": [None, None],
        "hot": [1200] * 5000 + [1201] * 100 + [90_000],
        "huge": [0, 2**40, 2**41],
        "negative": [-1500, -1, 0, 1, 1500],
    }
    check(percentiles(spark, groups, few_groups), groups)


def test_partitioning_does_not_matter(spark):
    groups = {str(g): [(i * i * 31 + g) % 50_000 for i in range(300)] for g in range(5)}
    check(percentiles(spark, groups, False, partitions=1), groups)
    check(percentiles(spark, groups, False, partitions=17), groups)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 5000), min_size=1, max_size=60), min_size=1, max_size=4))
def test_random_groups(spark, lists):
    groups = {str(i): values for i, values in enumerate(lists)}
    check(percentiles(spark, groups, True), groups)


def test_equals_spark_percentile(spark):
    df = spark.range(3000).selectExpr("id % 7 AS g", "id * id % 9973 AS ms")
    hist = group_by(df, ["g", "ms"], ["count(1) AS n"])
    found = exact_percentiles(hist, ["g"], "ms", [50, 95]).selectExpr("g", "p50_x100 / 100D", "p95_x100 / 100D")
    builtin = df.groupBy("g").agg(F.percentile("ms", 0.5).alias("a"), F.percentile("ms", 0.95).alias("b"))
    got, want = ({r[0]: (r[1], r[2]) for r in x.collect()} for x in (found, builtin))
    assert got.keys() == want.keys()
    for g in got:
        assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(got[g], want[g]))
