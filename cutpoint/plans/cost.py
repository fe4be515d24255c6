"""Cost reports: credits per day and per query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.functions import explanations as X
from cutpoint.functions.ladders import breakeven, cost_consistency
from cutpoint.functions.numeric import change_pct, ratio, rounded
from cutpoint.functions.welch import linear_interval, significance
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
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by

IS_METERED = "is_metered"
SCOPES = ("all", "pat")


def cost_daily(w: Workload) -> DataFrame:
    """Credits of each metered day over its uncached runs and over its comparable runs.

    Credits cover the whole warehouse, so credits per pattern query are an upper bound.
    """
    return w.cost_days.where(IS_METERED).select(
        *w.cfg.keys,
        "activity_date",
        "period_type",
        "day_of_week_num",
        "day_of_week",
        "daily_credits",
        "all_query_count",
        "all_credits_per_query",
        "pattern_query_count",
        "wh_credits_per_pattern_query",
    )


def cost_moments() -> list[str]:
    """Period aggregates over days behind the cost test.

    Days without a ratio are left out of the tests but stay in the weighted and raw figures.
    Counts and credits are NULL on days without metering, so those take no part.
    """
    return [
        *moments("all", "all_credits_per_query"),
        *moments("pat", "wh_credits_per_pattern_query"),
        *per_period("credits", "sum", "CAST(daily_credits AS DECIMAL(28,4))"),
        *per_period("all_runs", "sum", "all_query_count"),
        *per_period("pat_runs", "sum", "pattern_query_count"),
        *per_period("day_credits", "avg", "daily_credits"),
        *per_period("day_all_runs", "avg", "all_query_count"),
        *per_period("day_pat_runs", "avg", "pattern_query_count"),
    ]


def cost_present() -> str:
    return f"{in_both_periods('all_n')} AND {in_both_periods('pat_n')}"


def cost_effects() -> dict[str, str]:
    """Cost changes of both scopes, over ``cost_moments``."""
    effects = {}
    for scope in SCOPES:
        before, after = samples(scope)
        effects[f"{scope}_change"] = change_pct(before.mean, after.mean)
        for s in PERIODS:
            effects[f"{s}_{scope}_weighted"] = rounded(ratio(f"{s}_credits", f"{s}_{scope}_runs"), 6)
    return effects


def cost_results() -> dict[str, str]:
    """Intervals and labels of both scopes, over ``cost_effects`` with both tests added."""
    results = {"breakeven_status": breakeven("all_change")}
    for scope in SCOPES:
        lower, upper = linear_interval(
            f"{scope}_change", f"{scope}_t90", f"{scope}_se", f"b_{scope}_mean"
        )
        weighted = change_pct(f"b_{scope}_weighted", f"g_{scope}_weighted")
        results |= {
            f"{scope}_change_pct": rounded(f"{scope}_change", 2),
            f"{scope}_ci_lower": rounded(lower, 2),
            f"{scope}_ci_upper": rounded(upper, 2),
            f"{scope}_significance": significance(*tested(scope)),
            f"{scope}_weighted_change": weighted,
            f"{scope}_gap": f"abs({scope}_change - {weighted})",
        }
    return results


def cost_welch_test(w: Workload) -> DataFrame:
    """Cost test: one row (per key). Empty unless both periods have days with both cost ratios."""
    found = group_by(w.cost_days, [*w.cfg.keys], cost_moments()).where(cost_present())
    found = add(with_welch(add(found, cost_effects()), *SCOPES), cost_results())
    found = add(found, {"consistency": cost_consistency("all_gap", "pat_gap")})

    def raw(name: str, alias: str, change: str, places: int) -> list[str]:
        b, g = f"b_{name}", f"g_{name}"
        return [
            f"{rounded(b, places)} AS gen1_{alias}",
            f"{rounded(g, places)} AS gen2_{alias}",
            f"{rounded(change_pct(b, g), 2)} AS {change}",
        ]

    return found.selectExpr(
        "'COST' AS metric_category",
        *w.cfg.keys,
        "b_all_n AS gen1_days",
        "g_all_n AS gen2_days",
        f"{rounded('b_all_mean', 6)} AS gen1_all_avg_credits_per_query",
        f"{rounded('g_all_mean', 6)} AS gen2_all_avg_credits_per_query",
        "all_change_pct AS all_avg_cpq_change_pct",
        "all_ci_lower AS all_avg_cpq_ci_lower_90",
        "all_ci_upper AS all_avg_cpq_ci_upper_90",
        f"{rounded('all_t', 3)} AS t_statistic",
        f"{rounded('all_df', 1)} AS degrees_of_freedom",
        "all_significance AS significance",
        f"{X.explain('all_significance', X.COST_SIGNIFICANCE)} AS significance_explanation",
        "b_all_weighted AS gen1_all_weighted_credits_per_query",
        "g_all_weighted AS gen2_all_weighted_credits_per_query",
        f"{rounded('all_weighted_change', 2)} AS all_weighted_cpq_change_pct",
        f"{rounded('b_pat_mean', 6)} AS gen1_avg_cost_per_pattern_query",
        f"{rounded('g_pat_mean', 6)} AS gen2_avg_cost_per_pattern_query",
        "pat_change_pct AS avg_cost_per_pattern_query_change_pct",
        "pat_ci_lower AS avg_cost_per_pattern_query_ci_lower_90",
        "pat_ci_upper AS avg_cost_per_pattern_query_ci_upper_90",
        f"{rounded('pat_t', 3)} AS pattern_cost_t_statistic",
        f"{rounded('pat_df', 1)} AS pattern_cost_degrees_of_freedom",
        "pat_significance AS pattern_cost_significance",
        "b_pat_weighted AS gen1_weighted_cost_per_pattern_query",
        "g_pat_weighted AS gen2_weighted_cost_per_pattern_query",
        f"{rounded('pat_weighted_change', 2)} AS weighted_cost_per_pattern_query_change_pct",
        *raw("day_credits", "daily_credits", "total_credit_change_pct", 4),
        *raw("day_all_runs", "daily_all_queries", "all_query_volume_change_pct", 0),
        *raw("day_pat_runs", "daily_pattern_queries", "pattern_query_volume_change_pct", 0),
        "breakeven_status",
        f"{X.explain('breakeven_status', X.BREAKEVEN)} AS breakeven_explanation",
        f"{rounded('all_gap', 1)} AS all_cpq_avg_vs_weighted_divergence_pp",
        f"{rounded('pat_gap', 1)} AS pattern_cpq_avg_vs_weighted_divergence_pp",
        f"concat(consistency, ' — ', {X.explain('consistency', X.CONSISTENCY)})"
        " AS cost_metric_consistency",
    )


# Weekday averages: day column, decimals, output name, change column. Changes compare the rounded
# averages.
WEEKDAY_MEASURES = (
    ("daily_credits", 4, "avg_daily_credits", "credit_change_pct"),
    ("all_query_count", 0, "all_queries", "all_query_volume_change_pct"),
    ("all_credits_per_query", 6, "all_credits_per_query", "all_cpq_change_pct"),
    ("pattern_query_count", 0, "pattern_queries", "pattern_query_volume_change_pct"),
    ("wh_credits_per_pattern_query", 6, "wh_credits_per_pattern_query", "pattern_cpq_change_pct"),
)


def cost_by_dow(w: Workload) -> DataFrame:
    """Credits and volume per weekday that is metered in both periods."""
    weekday = [*w.cfg.keys, "day_of_week_num", "day_of_week"]
    averages = group_by(
        w.cost_days.where(IS_METERED),
        weekday,
        [
            *per_period("days", "count", "1"),
            *[a for day, *_ in WEEKDAY_MEASURES for a in per_period(day, "avg", day)],
        ],
    ).where(in_both_periods("days"))
    shown_averages = averages.selectExpr(
        *weekday,
        "b_days",
        "g_days",
        *[
            f"{rounded(f'{s}_{day}', places)} AS {s}_{day}"
            for day, places, *_ in WEEKDAY_MEASURES
            for s in PERIODS
        ],
    )
    return shown_averages.selectExpr(
        *weekday,
        "b_days AS gen1_samples",
        "g_days AS gen2_samples",
        *[
            column
            for day, _, name, change in WEEKDAY_MEASURES
            for column in (
                f"b_{day} AS gen1_{name}",
                f"g_{day} AS gen2_{name}",
                f"{rounded(change_pct(f'b_{day}', f'g_{day}'), 2)} AS {change}",
            )
        ],
    ).orderBy(*w.cfg.keys, "day_of_week_num")


def daily_trend(w: Workload) -> DataFrame:
    """Cost and performance of each metered day; performance is NULL on days without comparable runs."""
    perf = {
        "day_of_week": "day_of_week",
        "query_count": "perf_pattern_query_count",
        "median_exec_sec": "pattern_median_exec_sec",
        "p95_exec_sec": "pattern_p95_exec_sec",
        "success_rate_pct": "pattern_success_rate_pct",
    }
    return w.trend_days.where(IS_METERED).selectExpr(
        *w.cfg.keys,
        "activity_date",
        "period_type",
        *[f"CASE WHEN query_count > 0 THEN {c} END AS {name}" for c, name in perf.items()],
        "all_query_count",
        "daily_credits AS all_warehouse_daily_credits",
        "all_credits_per_query AS all_warehouse_credits_per_query",
        "pattern_query_count AS cost_pattern_query_count",
        "wh_credits_per_pattern_query",
    ).orderBy(*w.cfg.keys, "activity_date")
