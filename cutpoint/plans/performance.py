"""Performance reports: daily, by weekday, and the overall test."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.functions import explanations as X
from cutpoint.functions import labels as L
from cutpoint.functions.ladders import queue_saturation, tail_latency
from cutpoint.functions.numeric import change_pct, percent, ratio, rounded, shown, speedup_pct, text
from cutpoint.functions.welch import fieller_interval, fieller_terms, linear_interval, significance
from cutpoint.operators.cells import EXEC, IS_COMPARABLE
from cutpoint.operators.compare import (
    PERIODS,
    add,
    in_both_periods,
    moments,
    per_period,
    samples,
    tested,
    with_welch,
)
from cutpoint.operators.daily import daily_counts, seconds, with_calendar
from cutpoint.operators.quantiles import exact_percentiles
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by, join_by

HAS_PERF = "query_count > 0"


def perf_daily(w: Workload) -> DataFrame:
    """Execution times and tail of each day's comparable runs. Days without any are left out."""
    return w.query_days.where(HAS_PERF).selectExpr(
        *w.cfg.keys,
        "activity_date",
        "period_type",
        "day_of_week_num",
        "day_of_week",
        "query_count",
        "median_exec_sec",
        "p95_exec_sec",
        "p99_exec_sec",
        "p95_tail_count",
        "p95_tail_weight_pct",
        "query_count AS successful_queries",
        "success_rate_pct",
    )


def perf_welch_test(w: Workload) -> DataFrame:
    """Welch test per weekday. Exploratory: few days per weekday, no correction for seven tests."""
    weekday = [*w.cfg.keys, "day_of_week_num", "day_of_week"]
    least = w.cfg.thresholds.min_days_per_weekday
    found = group_by(
        w.query_days.where(HAS_PERF), weekday, moments("exec", "median_exec_sec", HAS_PERF)
    ).where(f"b_exec_n >= {least} AND g_exec_n >= {least}")
    before, after = samples("exec")
    found = add(
        with_welch(found, "exec"),
        {
            # The weekday test rounds its effect before it adds the interval.
            "speedup_pct": rounded(speedup_pct(before.mean, after.mean), 2),
            "significance": significance(*tested("exec")),
        },
    )
    lower, upper = linear_interval("speedup_pct", "exec_t90", "exec_se", before.mean)
    return found.selectExpr(
        f"{text(L.EXPLORATORY)} AS test_scope",
        *weekday,
        "b_exec_n AS n_gen1",
        "g_exec_n AS n_gen2",
        f"{rounded(before.mean, 4)} AS gen1_median_exec_sec",
        f"{rounded(after.mean, 4)} AS gen2_median_exec_sec",
        "speedup_pct",
        f"{rounded('exec_t', 3)} AS t_statistic",
        f"{rounded('exec_df', 1)} AS degrees_of_freedom",
        "exec_t90 AS t_critical_90",
        f"{rounded(lower, 2)} AS speedup_ci_lower_90",
        f"{rounded(upper, 2)} AS speedup_ci_upper_90",
        "significance",
        f"{X.explain('significance', X.WEEKDAY_SIGNIFICANCE)} AS significance_explanation",
    ).orderBy(*w.cfg.keys, "day_of_week_num")


def perf_by_dow(w: Workload) -> DataFrame:
    """Percentiles over all runs of a weekday and period, for all live runs and for comparable ones.

    The success rate is taken among successful runs and so is always 100, as in the definition
    this report follows; failed runs do count in the all-query percentiles.
    """
    cfg = w.cfg
    weekday = [*cfg.keys, "day_of_week_num", "day_of_week"]
    group = [*weekday, "period_type", "scope"]
    live = with_calendar(w.cells.where(f"measure = '{EXEC}' AND is_live"), cfg).selectExpr(
        *weekday,
        "period_type",
        f"explode(CASE WHEN {IS_COMPARABLE} THEN array('all', 'pattern') ELSE array('all') END) AS scope",
        "ms",
        "n",
    )
    hist = group_by(live, [*group, "ms"], ["sum(n) AS n"])
    found = exact_percentiles(hist, group, "ms", [50, 95, 99], few_groups=not cfg.keys, keys=cfg.keys)
    names = {50: "median", 95: "p95", 99: "p99"}
    picks = [
        f"max(CASE WHEN period_type = '{label}' AND scope = '{scope}' THEN p{p}_x100 END)"
        f" AS {side}_{scope}_{p}"
        for side, label in PERIODS.items()
        for scope in ("all", "pattern")
        for p in names
    ]
    times = group_by(found, weekday, picks)
    counts = group_by(
        with_calendar(daily_counts(w.cells.where(f"measure = '{EXEC}'"), cfg).where(HAS_PERF), cfg),
        weekday,
        [*per_period("days", "count", "1"), *per_period("runs", "sum", "query_count")],
    ).where(in_both_periods("days"))
    rates = {
        f"{s}_{name}": value
        for s in PERIODS
        for name, value in {
            "avg": rounded(ratio(f"{s}_runs", f"{s}_days"), 0),
            "rate": rounded(percent(f"{s}_runs", f"{s}_runs"), 2),
            **{
                f"{scope}_{p}_sec": rounded(seconds(f"{s}_{scope}_{p}"), 4)
                for scope in ("all", "pattern")
                for p in names
            },
        }.items()
    }
    triples = [
        column
        for p, name in names.items()
        for scope in ("all", "pattern")
        for column in (
            f"b_{scope}_{p}_sec AS {scope}_gen1_{name}_exec_sec",
            f"g_{scope}_{p}_sec AS {scope}_gen2_{name}_exec_sec",
            f"{rounded(speedup_pct(f'b_{scope}_{p}_sec', f'g_{scope}_{p}_sec'), 2)}"
            f" AS {scope}_{name}_exec_speedup_pct",
        )
    ]
    return add(join_by(counts, times, cfg.keys, weekday, "left"), rates).selectExpr(
        *weekday,
        "b_days AS gen1_days",
        "g_days AS gen2_days",
        "b_avg AS gen1_avg_daily_queries",
        "g_avg AS gen2_avg_daily_queries",
        f"{rounded(change_pct('b_avg', 'g_avg'), 2)} AS avg_daily_queries_change_pct",
        *triples,
        "b_rate AS gen1_success_rate_pct",
        "g_rate AS gen2_success_rate_pct",
        f"{rounded('g_rate - b_rate', 2)} AS success_rate_diff_pp",
    ).orderBy(*cfg.keys, "day_of_week_num")


def perf_moments() -> list[str]:
    """Period aggregates over days behind the overall test."""
    return [
        *moments("exec", "median_exec_sec", HAS_PERF),
        *per_period("p95", "avg", "p95_exec_sec"),
        *per_period("p99", "avg", "p99_exec_sec"),
        *per_period("queue_p50", "avg", "median_queue_sec"),
        *per_period("queue_p95", "avg", "p95_queue_sec"),
    ]


def perf_present() -> str:
    return in_both_periods("exec_n")


def with_fieller(df: DataFrame) -> DataFrame:
    """Add the terms of the speedup interval, over ``perf_moments`` with the exec test added."""
    for step in fieller_terms("exec", *samples("exec"), "exec_t90"):
        df = add(df, step)
    return df


def perf_results() -> dict[str, str]:
    """Results of the overall test, over ``with_fieller``."""
    before, after = samples("exec")
    lower, upper = fieller_interval("exec")
    return {
        "perf_gen1_sec": rounded(before.mean, 4),
        "perf_gen2_sec": rounded(after.mean, 4),
        "perf_speedup_pct": rounded(speedup_pct(before.mean, after.mean), 2),
        "perf_ci_lower": rounded(lower, 2),
        "perf_ci_upper": rounded(upper, 2),
        "perf_significance": significance(*tested("exec")),
        "perf_tail": tail_latency("b_p99", "g_p99"),
        "perf_queue": queue_saturation("b_queue_p95", "g_queue_p95"),
    }


def _queue_texts() -> dict[str, str]:
    move = f"{shown('b_queue_p95', 2)}, 's → ', {shown('g_queue_p95', 2)}, 's.'"
    return {
        L.QUEUE_NEGLIGIBLE: "Queries hardly wait in either period (P95 under 0.1s).",
        L.QUEUE_WARNING: f"concat('P95 waiting time more than doubled: ', {move})",
        L.QUEUE_CAUTION: f"concat('P95 waiting time rose by over 50%: ', {move})",
        L.QUEUE_IMPROVED: "P95 waiting time fell by a fifth or more.",
        L.OK: "P95 waiting time is comparable in both periods.",
    }


def perf_summary(w: Workload) -> DataFrame:
    """Overall test: one row (per key). Empty unless both periods have comparable days."""
    found = group_by(w.queue_days, [*w.cfg.keys], perf_moments()).where(perf_present())
    return add(with_fieller(with_welch(found, "exec")), perf_results()).selectExpr(
        "'PERFORMANCE' AS metric_category",
        *w.cfg.keys,
        "b_exec_n AS gen1_days",
        "g_exec_n AS gen2_days",
        "perf_gen1_sec AS gen1_daily_median_sec",
        "perf_gen2_sec AS gen2_daily_median_sec",
        "perf_speedup_pct AS speedup_pct",
        "perf_ci_lower AS speedup_ci_lower_90",
        "perf_ci_upper AS speedup_ci_upper_90",
        f"{rounded('exec_t', 3)} AS t_statistic",
        f"{rounded('exec_df', 1)} AS degrees_of_freedom",
        "perf_significance AS significance",
        f"{X.explain('perf_significance', X.PERF_SIGNIFICANCE)} AS significance_explanation",
        f"{rounded('b_p95', 4)} AS gen1_mean_p95",
        f"{rounded('g_p95', 4)} AS gen2_mean_p95",
        f"{rounded('b_p99', 4)} AS gen1_mean_p99",
        f"{rounded('g_p99', 4)} AS gen2_mean_p99",
        "perf_tail AS tail_latency_check",
        f"{X.explain('perf_tail', X.TAIL)} AS tail_latency_explanation",
        f"{rounded('b_queue_p50', 4)} AS gen1_mean_median_queue_sec",
        f"{rounded('g_queue_p50', 4)} AS gen2_mean_median_queue_sec",
        f"{rounded('b_queue_p95', 4)} AS gen1_mean_p95_queue_sec",
        f"{rounded('g_queue_p95', 4)} AS gen2_mean_p95_queue_sec",
        "perf_queue AS queue_saturation_check",
        f"{X.explain('perf_queue', _queue_texts())} AS queue_saturation_explanation",
    )


def queue_daily(w: Workload) -> DataFrame:
    """Waiting time of each day, over every run: cached, failed and unmatched ones wait too."""
    return w.queue_days.select(
        *w.cfg.keys, "activity_date", "period_type", "median_queue_sec", "p95_queue_sec"
    )
