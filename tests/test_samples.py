"""Samples of first runs by their place in the files, and what is read for them."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import replace

import pytest

from cutpoint import Workload
from cutpoint.config import Tuning
from cutpoint.functions import labels as L
from cutpoint.operators.samples import PLACE_COLUMNS, SAMPLE_TEXT, only_values
from cutpoint.plans import staging
from cutpoint.plans.regressions import pattern_regressions, top_patterns
from cutpoint.plans.reliability import error_analysis
from cutpoint.session import new_table_path
from cutpoint.sources.schema import QUERY_HISTORY, read_staged
from tests.conftest import CUTOVER

BY_JOINS = Tuning(lookup_values=0, lookup_files=0, broadcast_max_rows=0)


def staged(facts, **config) -> Workload:
    """The facts in a written table."""
    w = facts.workload(first_run_samples=True, **config)
    path = new_table_path(facts.spark, "query_history")
    staging.refresh_query_history(facts.sources()[0], path, w.cfg, CUTOVER + dt.timedelta(days=30))
    return Workload(read_staged(facts.spark, path, QUERY_HISTORY), w.metering, w.cfg)


def add_runs(facts, **more):
    for n, factor in ((-1, 1), (1, 2)):
        for _ in range(10):
            facts.run(n, 1000 * factor, "slower", query_text="later", **more)
            facts.run(n, 1000 * factor, "it's \\ slower", **more)
    early = dt.datetime.combine(CUTOVER - dt.timedelta(days=3), dt.time(5))
    facts.run(-3, 1000, "slower", query_text="second", **more)
    facts.run(-3, 1000, "slower", query_text="a smaller text", **more)
    facts.run(-3, 1000, "slower", query_text="z first " + "x" * 300, warehouse="ANALYTICS_B", **more | {"start_time": early})
    facts.run(-3, 1000, "slower", query_text="failed", status="FAIL", **more | {"start_time": early})
    facts.run(2, 1000, "slower", query_text="b failed after", status="FAIL", **more)
    facts.run(2, 1000, "other", query_text="a failed after", status="FAIL", **more)


@pytest.mark.parametrize("tuning", [Tuning(), BY_JOINS])
def test_first_runs_of_patterns_and_errors(facts, tuning):
    add_runs(facts)
    w = staged(facts, tuning=tuning)
    found = {r["pattern_hash"]: (r["sample_query"], r["sample_warehouse"]) for r in pattern_regressions(w).collect()}
    want = {"slower": ("z first " + "x" * 192, "ANALYTICS_B"), "it's \\ slower": ("text it's \\ slower", "ANALYTICS_A")}
    assert found == want
    top = {r["pattern_hash"]: (r["sample_query"], r["sample_warehouse"]) for r in top_patterns(w, L.REGRESSION).collect()}
    assert top == want
    assert [(r["execution_status"], r["sample_query"]) for r in error_analysis(w).collect()] == [("FAIL", "b failed after")]


@pytest.mark.parametrize("tuning", [Tuning(), BY_JOINS])
def test_first_runs_per_key_with_a_null_key(facts, tuning):
    for user in (None, "u"):
        add_runs(facts, user_name=user)
    found = pattern_regressions(staged(facts, keys=("user_name",), tuning=tuning)).where("pattern_hash = 'slower'").collect()
    assert sorted((r["user_name"] or "", r["sample_query"][:7], r["sample_warehouse"]) for r in found) == [
        ("", "z first", "ANALYTICS_B"),
        ("u", "z first", "ANALYTICS_B"),
    ]


def test_runs_alike_in_time_and_id_give_one_sample(facts):
    for n, factor in ((-1, 1), (1, 2)):
        for i in range(10):
            facts.run(n, 1000 * factor, "slower", query_text=f"text {i}", query_id=None)
    w = staged(facts)
    first, again = (pattern_regressions(w).collect() for _ in range(2))
    assert len(first) == 1 and first == again and first[0]["sample_query"].startswith("text ")


def test_no_rows_and_no_files(facts):
    facts.run(-1)
    w = staged(facts)
    assert pattern_regressions(w).collect() == [] and top_patterns(w, L.STABLE).collect() == []
    kept = facts.workload(first_run_samples=True)
    with pytest.raises(ValueError, match="read from files"):
        pattern_regressions(kept).collect()


def test_only_values(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a'), ('b'), (NULL) AS t(v)")

    def kept(wanted: str, limit: int) -> list:
        found = only_values(rows, "v", spark.sql(f"SELECT * FROM VALUES {wanted} AS t(w)"), "w", limit)
        return sorted(r[0] or "" for r in found.collect())

    assert kept("('a'), ('a')", 1) == ["a"]
    assert kept("('a'), ('b')", 1) == kept("('a'), (NULL)", 5) == ["", "a", "b"]
    none = only_values(rows, "v", rows.selectExpr("v AS w").where("false"), "w", 5)
    assert none.collect() == []


def columns_read(df) -> list[set[str]]:
    """Columns of each scan of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan)]


def test_the_text_is_read_in_the_fetch_alone(facts):
    add_runs(facts)
    w = staged(facts)
    facts.spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    scans = [c for c in columns_read(pattern_regressions(w)) if "query_text" in c]
    assert len(scans) == 1 and not scans[0] & {"start_time", "query_id", "execution_time"}


@pytest.fixture(scope="module")
def appended(compiled_spark):
    """One day in two loads: patterns of even and of odd numbers, whose ranges overlap, with wide texts."""
    path = new_table_path(compiled_spark, "query_history")
    for odd in (0, 1):
        rows = compiled_spark.range(60_000).selectExpr(
            "CAST(id AS STRING) AS query_id",
            "sha2(CAST(id AS STRING), 512) AS query_text",
            f"lpad(2 * id + {odd}, 12, '0') || sha2(CAST(id AS STRING), 256) AS query_parameterized_hash",
            "'ANALYTICS_A' AS warehouse_name",
            "DATE'2024-03-01' AS activity_date",
        )
        staging._write(rows, path, ["query_parameterized_hash"], "append")
    return compiled_spark.read.parquet(path)


def bytes_read(spark, df) -> int:
    """Bytes read from files to compute all columns of all rows."""
    every = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()

    def total() -> int:
        return sum(every.get(i).getBytesRead() for i in range(every.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.fixture
def counted(compiled_spark):
    """Reads in the plain way: the statistics of a file system don't count the vectored one."""
    compiled_spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    yield compiled_spark
    compiled_spark.conf.unset("parquet.hadoop.vectored.io.enabled")
    compiled_spark.conf.unset("parquet.filter.bloom.enabled")


def test_bloom_filters_are_read_instead_of_texts(counted, appended):
    known = appended.where("query_id = '30000'").orderBy("query_parameterized_hash").first()["query_parameterized_hash"]

    def lookup(value: str):
        wanted = counted.createDataFrame([(value,)], "w string")
        return only_values(appended, "query_parameterized_hash", wanted, "w", 64).selectExpr(SAMPLE_TEXT, *PLACE_COLUMNS)

    # A pattern within the ranges of both loads, in neither.
    one, none = lookup(known), lookup(known[:12] + "f" * 64)
    assert "EqualTo(query_parameterized_hash" in one._jdf.queryExecution().executedPlan().toString()
    assert len(one.collect()) == 1 and none.collect() == []
    everything = bytes_read(counted, appended.select("query_parameterized_hash", "query_text"))
    with_filters = bytes_read(counted, one), bytes_read(counted, none)
    counted.conf.set("parquet.filter.bloom.enabled", "false")
    without = bytes_read(counted, one), bytes_read(counted, none)
    assert with_filters[0] < everything / 5 and with_filters[1] < everything / 50
    assert with_filters[0] < without[0] * 0.7 and with_filters[1] < without[1] / 10


def test_a_report_of_few_patterns_asks_for_them_by_value(facts):
    add_runs(facts)
    w = staged(facts)
    plain = Workload(w.query_history, w.metering, replace(w.cfg, first_run_samples=False))
    for each in (w, plain):
        plan = top_patterns(each, L.REGRESSION)._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(query_parameterized_hash,slower)" in plan
