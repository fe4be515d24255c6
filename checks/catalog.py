"""Every query of the entry point: name → function of (spark, folder of the driver tables)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.scenarios import SCENARIOS
from cutpoint.config import Thresholds, Tuning
from cutpoint.functions.numeric import ratio, rounded
from cutpoint.operators.counterfactual import with_effects
from cutpoint.plans import performance, reliability, reports, staging
from cutpoint.plans.cost import IS_METERED
from cutpoint.plans.decision import PROSE
from cutpoint.plans.incremental import DailyState
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by, new_table_path
from cutpoint.sources import bindings
from cutpoint.sources.schema import METERING, QUERY_HISTORY, read_staged
from cutpoint.sources.snapshots import Snapshots

Query = Callable[[SparkSession, str], DataFrame]

# The events end in January 2024; staging sees them as of these days.
EARLY_LOAD = date(2024, 1, 17)
FIRST_LOAD = date(2024, 1, 20)
LAST_LOAD = date(2024, 2, 1)


def events_workload(spark: SparkSession, sf_dir: str, *, share: bool = False) -> Workload:
    cfg = bindings.EVENTS_CONFIG
    return Workload(
        staging.stage_query_rows(bindings.events_query_history(spark, sf_dir), cfg),
        staging.stage_metering_rows(bindings.events_metering(spark, sf_dir), cfg),
        cfg,
        share=share,
    )


def orders_workload(spark: SparkSession, sf_dir: str, *, share: bool = False) -> Workload:
    cfg = bindings.ORDERS_CONFIG
    return Workload(
        staging.stage_query_rows(bindings.orders_query_history(spark, sf_dir), cfg),
        staging.stage_metering_rows(bindings.orders_metering(spark, sf_dir), cfg),
        cfg,
        share=share,
    )


# ---- staging ------------------------------------------------------------------------------------

DIMENSIONS = [
    "start_time",
    "activity_date",
    "day_num",
    "day_of_week",
    "year_iso",
    "week_iso",
    "week_start_date",
]
QUERY_COLUMNS = [
    "query_id",
    "query_parameterized_hash",
    "execution_time",
    "warehouse_name",
    "execution_status",
    "bytes_scanned",
    *DIMENSIONS,
]
METERING_COLUMNS = ["warehouse_name", "CAST(credits_used AS DOUBLE) AS credits_used", *DIMENSIONS]


def stage_query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full refresh, written and read back."""
    path = new_table_path(spark, "query_history")
    source = bindings.events_query_history(spark, sf_dir)
    staging.refresh_query_history(source, path, bindings.EVENTS_CONFIG, LAST_LOAD)
    return read_staged(spark, path, QUERY_HISTORY).selectExpr(*QUERY_COLUMNS)


def stage_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "metering")
    source = bindings.events_metering(spark, sf_dir)
    staging.refresh_metering(source, path, bindings.EVENTS_CONFIG, LAST_LOAD)
    return read_staged(spark, path, METERING).selectExpr(*METERING_COLUMNS)


def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First load up to one day, then the rest appended: the table of a full refresh."""
    path = new_table_path(spark, "query_history")
    source = bindings.events_query_history(spark, sf_dir)
    staging.append_query_history(source, path, bindings.EVENTS_CONFIG, FIRST_LOAD)
    staging.append_query_history(source, path, bindings.EVENTS_CONFIG, LAST_LOAD)
    return read_staged(spark, path, QUERY_HISTORY).selectExpr(*QUERY_COLUMNS)


def metering_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first load whose credits are still too low, then reloads from its last interval on."""
    path = new_table_path(spark, "metering")
    cfg = bindings.EVENTS_CONFIG
    source = bindings.events_metering(spark, sf_dir)
    last = group_by(source.where("start_time < TIMESTAMP_NTZ'2024-01-20 00:00:00'"), [], ["max(start_time)"])
    early = last.first()[0]
    unfinished = source.selectExpr(
        *[c for c in source.columns if c != "credits_used"],
        f"CASE WHEN start_time = TIMESTAMP_NTZ'{early}' THEN credits_used / 2 ELSE credits_used END"
        " AS credits_used",
    )
    staging.reload_metering(unfinished, path, cfg, FIRST_LOAD)
    staging.reload_metering(source, path, cfg, LAST_LOAD)
    staging.reload_metering(source, path, cfg, LAST_LOAD)
    return read_staged(spark, path, METERING).selectExpr(*METERING_COLUMNS)


def _withdrawn(source: DataFrame) -> DataFrame:
    """A row on a day that the source doesn't have later."""
    return source.orderBy("start_time", "warehouse_name").limit(1).selectExpr(
        *[
            f"TIMESTAMP_NTZ'2024-01-31 23:00:00' AS {c}" if c in ("start_time", "end_time") else c
            for c in source.columns
        ]
    )


def metering_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first load that holds a row on a day which the source withdraws before the next load."""
    path = new_table_path(spark, "metering")
    cfg = bindings.EVENTS_CONFIG
    source = bindings.events_metering(spark, sf_dir)
    staging.reload_metering(source.unionByName(_withdrawn(source)), path, cfg, LAST_LOAD)
    staging.reload_metering(source, path, cfg, LAST_LOAD)
    return read_staged(spark, path, METERING).selectExpr(*METERING_COLUMNS)


def staging_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = bindings.EVENTS_CONFIG
    return staging.coverage(
        staging.stage_query_rows(bindings.events_query_history(spark, sf_dir), cfg, LAST_LOAD),
        staging.stage_metering_rows(bindings.events_metering(spark, sf_dir), cfg, LAST_LOAD),
        cfg,
    )


def staging_coverage_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of written tables, one of which has lost a day: from their listings."""
    cfg = bindings.EVENTS_CONFIG
    runs, meters = new_table_path(spark, "query_history"), new_table_path(spark, "metering")
    staging.append_query_history(bindings.events_query_history(spark, sf_dir), runs, cfg, FIRST_LOAD)
    staging.append_query_history(bindings.events_query_history(spark, sf_dir), runs, cfg, LAST_LOAD)
    source = bindings.events_metering(spark, sf_dir)
    staging.reload_metering(source.unionByName(_withdrawn(source)), meters, cfg, LAST_LOAD)
    staging.reload_metering(source, meters, cfg, LAST_LOAD)
    return staging.coverage_of(spark, runs, meters, cfg)


def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark of a first load, as a one-row table."""
    path = new_table_path(spark, "query_history")
    source = bindings.events_query_history(spark, sf_dir)
    staging.append_query_history(source, path, bindings.EVENTS_CONFIG, FIRST_LOAD)
    mark = staging.high_water_mark(read_staged(spark, path, QUERY_HISTORY))
    return spark.sql(f"SELECT TIMESTAMP_NTZ'{mark}' AS high_water_mark")


def metering_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``metering_withdrawn``, in a table of snapshots: early credits are revised and a day goes, in one step each."""
    path = new_table_path(spark, "metering")
    cfg = bindings.EVENTS_CONFIG
    source = bindings.events_metering(spark, sf_dir)
    staging.replace_metering(source.unionByName(_withdrawn(source)), path, cfg, FIRST_LOAD)
    staging.replace_metering(source.unionByName(_withdrawn(source)), path, cfg, LAST_LOAD)
    staging.replace_metering(source, path, cfg, LAST_LOAD)
    return Snapshots(spark, path).read(METERING).selectExpr(*METERING_COLUMNS)


def incremental(report: Callable[[Workload], DataFrame]) -> Query:
    """A report of daily state: built for a first load, brought up to date after two more."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        runs, meters, cells = (new_table_path(spark, n) for n in ("query_history", "metering", "state"))
        cfg = bindings.EVENTS_CONFIG
        state = DailyState(spark, cells, runs, cfg)
        for as_of in (EARLY_LOAD, FIRST_LOAD, LAST_LOAD):
            staging.append_query_history(bindings.events_query_history(spark, sf_dir), runs, cfg, as_of)
            staging.replace_metering(bindings.events_metering(spark, sf_dir), meters, cfg, as_of)
            state.update()
        return without_prose(report(state.workload(Snapshots(spark, meters).read(METERING))))

    return run


# ---- parts of reports ---------------------------------------------------------------------------


def scope_rows(w: Workload) -> DataFrame:
    return w.count_days.select(
        "activity_date", "period_type", "total_queries", "pattern_queries", "cached_queries", "live_queries"
    )


def perf_tail(w: Workload) -> DataFrame:
    return performance.perf_daily(w).select("activity_date", "p95_tail_count", "p95_tail_weight_pct")


def cost_weighted(w: Workload) -> DataFrame:
    sums = group_by(
        w.cost_days.where(IS_METERED),
        ["period_type"],
        [
            "CAST(sum(CAST(daily_credits AS DECIMAL(28,4))) AS DOUBLE) AS total_credits",
            "sum(all_query_count) AS all_queries",
            "sum(pattern_query_count) AS pattern_queries",
        ],
    )
    return sums.selectExpr(
        "*",
        f"{rounded(ratio('total_credits', 'all_queries'), 6)} AS weighted_all_credits_per_query",
        f"{rounded(ratio('total_credits', 'pattern_queries'), 6)} AS weighted_wh_credits_per_pattern_query",
    )


def without_prose(df: DataFrame) -> DataFrame:
    """Drop explanations: they are our own words and have no counterpart to compare with."""
    if "pattern_coverage_assessment" in df.columns:
        df = df.withColumn("pattern_coverage_assessment", F.substring_index("pattern_coverage_assessment", ":", 1))
    if "cost_metric_consistency" in df.columns:
        df = df.withColumn("cost_metric_consistency", F.substring_index("cost_metric_consistency", " — ", 1))
    prose = {*PROSE} - {"pattern_coverage_assessment", "cost_metric_consistency"}
    return df.drop(*[c for c in df.columns if c in prose or c.endswith("_explanation")])


# ---- what a configuration offers ----------------------------------------------------------------


def configured(w: Workload, **changes) -> Workload:
    return Workload(w.query_history, w.metering, replace(w.cfg, **changes))


def matched_rows_by_shuffle(w: Workload) -> DataFrame:
    """Marked runs per day, matched by the shuffle route in several partitions."""
    tuning = Tuning(broadcast_max_rows=0, shuffle_rows=1000)
    rows = configured(w, tuning=tuning).marked_rows
    return group_by(rows, ["activity_date"], ["count(*) AS runs", "count_if(is_pattern) AS pattern_runs"])


def keyed(report: Callable[[Workload], DataFrame], key: str, *, some_null: bool = False) -> Callable[[Workload], DataFrame]:
    """A report per key; with ``some_null`` one of the keys is NULL."""

    def run(w: Workload) -> DataFrame:
        if some_null:
            known = {key: f"nullif(warehouse_name, 'ANALYTICS_1') AS {key}"}
            runs, meters = (
                t.selectExpr(*[known.get(c, c) for c in dict.fromkeys([*t.columns, key])]) for t in (w.query_history, w.metering)
            )
            w = Workload(runs, meters, w.cfg)
        return without_prose(report(configured(w, keys=(key,))))

    return run


def decision_outcomes(w: Workload) -> DataFrame:
    """The decision under each of several effects of the change, in one job."""
    return reports.REPORTS["migration_decision"](with_effects(w, SCENARIOS))


def first_runs(report: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
    """A report whose sample texts are those of first runs."""
    return lambda w: report(configured(w, first_run_samples=True))


def perf_welch_test_two_days(w: Workload) -> DataFrame:
    """The weekday test from two days of a weekday on, which the month of events has."""
    return performance.perf_welch_test(configured(w, thresholds=Thresholds(min_days_per_weekday=2)))


def top_regressions_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest regressions over a written table: first runs and their texts by their places in its files."""
    path, cfg = new_table_path(spark, "query_history"), replace(bindings.ORDERS_CONFIG, first_run_samples=True)
    staging.refresh_query_history(bindings.orders_query_history(spark, sf_dir), path, cfg)
    meters = staging.stage_metering_rows(bindings.orders_metering(spark, sf_dir), cfg)
    return without_prose(reports.top_regressions(Workload(read_staged(spark, path, QUERY_HISTORY), meters, cfg)))


PER_CONFIGURATION: dict[str, Callable[[Workload], DataFrame]] = {
    "matched_rows_by_shuffle": matched_rows_by_shuffle,
    "perf_daily_per_user": keyed(performance.perf_daily, "user_name", some_null=True),
    "decision_outcomes": decision_outcomes,
    "perf_welch_test_two_days": perf_welch_test_two_days,
    "error_analysis_first_runs": first_runs(reports.REPORTS["error_analysis"]),
    "pattern_regressions_first_runs": first_runs(reports.REPORTS["pattern_regressions"]),
    "cost_daily_per_warehouse": keyed(reports.REPORTS["cost_daily"], "warehouse_name"),
}

PER_WORKLOAD: dict[str, Callable[[Workload], DataFrame]] = {
    "scope_rows": scope_rows,
    "matched_patterns": lambda w: w.matched_patterns,
    "perf_tail": perf_tail,
    "queue_daily": performance.queue_daily,
    "cost_weighted": cost_weighted,
    "success_daily": reliability.success_daily,
    "top_regressions": reports.top_regressions,
    "top_improvements": reports.top_improvements,
    **reports.REPORTS,
}


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "stage_query_history": stage_query_history,
        "stage_metering": stage_metering,
        "incremental_append": incremental_append,
        "metering_reload": metering_reload,
        "metering_withdrawn": metering_withdrawn,
        "staging_coverage": staging_coverage,
        "staging_coverage_written": staging_coverage_written,
        "high_water_mark": high_water_mark,
        "metering_snapshot": metering_snapshot,
        "perf_daily_incremental": incremental(performance.perf_daily),
        "queue_daily_incremental": incremental(performance.queue_daily),
        "top_regressions_staged": top_regressions_staged,
        "decision_incremental": incremental(reports.REPORTS["migration_decision"]),
    }
    for suffix, workload in (("", events_workload), ("_orders", orders_workload)):
        for name, report in (PER_WORKLOAD | PER_CONFIGURATION).items():

            def run(spark, sf_dir, workload=workload, report=report):
                return without_prose(report(workload(spark, sf_dir)))

            found[name + suffix] = run
    return found
