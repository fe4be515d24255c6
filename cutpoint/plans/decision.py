"""The decision: one explained assessment from performance, cost and reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.config import EVERYTHING, Thresholds
from cutpoint.functions import explanations as X
from cutpoint.functions import labels as L
from cutpoint.functions.dates import day
from cutpoint.functions.ladders import data_quality, pattern_coverage
from cutpoint.functions.numeric import first_match, labelled, number, ratio, rounded, shown, text
from cutpoint.operators.compare import add, with_welch
from cutpoint.plans.cost import SCOPES, cost_effects, cost_moments, cost_present, cost_results
from cutpoint.plans.performance import perf_moments, perf_present, perf_results, with_fieller
from cutpoint.plans.reliability import (
    reliability_moments,
    reliability_present,
    reliability_rates,
    reliability_results,
)
from cutpoint.plans.validation import volume_moments, volume_results
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by

PROSE = [
    "data_quality_explanation",
    "assessment_explanation",
    "reasoning",
    "metric_methodology",
    "last_updated",
]


def signals(w: Workload) -> DataFrame:
    """All figures the decision looks at, in one row (per key).

    Every test is an aggregate over the same daily rows, so one aggregate over ``all_days`` gives
    them together. No row unless each of the three tests has both periods.
    """
    found = group_by(
        w.all_days,
        [*w.cfg.keys],
        [*perf_moments(), *cost_moments(), *reliability_moments(), *volume_moments()],
    ).where(f"{perf_present()} AND {cost_present()} AND {reliability_present()}")
    found = with_welch(
        add(found, cost_effects() | reliability_rates() | volume_results()), "exec", "rate", *SCOPES
    )
    found = with_fieller(found)
    found = add(found, perf_results() | cost_results() | reliability_results(w.cfg.thresholds))
    return found.selectExpr(
        *w.cfg.keys,
        "b_query_days AS gen1_days",
        "g_query_days AS gen2_days",
        "b_all_queries AS gen1_total_queries",
        "g_all_queries AS gen2_total_queries",
        "b_coverage AS gen1_pattern_coverage_pct",
        "g_coverage AS gen2_pattern_coverage_pct",
        "perf_speedup_pct AS speedup_pct",
        "perf_ci_lower AS speedup_lower_bound",
        "perf_ci_upper AS speedup_upper_bound",
        "perf_significance",
        "perf_tail AS tail_latency_check",
        "perf_queue AS queue_saturation_check",
        "perf_gen1_sec AS gen1_daily_median_sec",
        "perf_gen2_sec AS gen2_daily_median_sec",
        "all_change_pct AS cost_change_pct",
        "all_ci_lower AS cost_change_lower_bound",
        "all_ci_upper AS cost_change_upper_bound",
        "all_significance AS cost_significance",
        "breakeven_status",
        f"{rounded('g_day_credits', 4)} AS gen2_daily_credits",
        "pat_change_pct AS pattern_cost_change_pct",
        "pat_ci_lower AS pattern_cost_change_lower_bound",
        "pat_ci_upper AS pattern_cost_change_upper_bound",
        "pat_significance AS pattern_cost_significance",
        "rel_gen1_rate AS gen1_success_rate",
        "rel_gen2_rate AS gen2_success_rate",
        "rel_diff_pp AS success_rate_diff_pp",
        "rel_status AS reliability_status",
    )


PER_DAY_BEFORE = ratio("gen1_total_queries", "gen1_days")
PER_DAY_AFTER = ratio("gen2_total_queries", "gen2_days")


def _subsecond(limits: Thresholds) -> str:
    least = number(limits.subsecond_median_sec)
    return f"(gen1_daily_median_sec < {least} OR gen2_daily_median_sec < {least})"


def _busy(limits: Thresholds) -> str:
    return f"coalesce({PER_DAY_AFTER}, 0D) >= {number(limits.high_volume_per_day)}"


def assessment(limits: Thresholds) -> str:
    """The cascade over ``signals``: first rule that is true. Unknown bounds fall through."""
    cost, cost_low, cost_high = "cost_change_pct", "cost_change_lower_bound", "cost_change_upper_bound"
    fast, fast_low, fast_high = "speedup_pct", "speedup_lower_bound", "speedup_upper_bound"
    early = "gen2_days < 14"
    spend = f"gen2_daily_credits > {number(limits.high_spend_credits_per_day)}"
    rules = [
        ("gen2_days < 7", L.INSUFFICIENT_DATA),
        ("startswith(reliability_status, 'DEGRADED')", L.UNFAVORABLE_RELIABILITY),
        ("startswith(reliability_status, 'MINOR DEGRADATION')", L.MIXED_RELIABILITY),
        ("startswith(tail_latency_check, 'WARNING')", L.MIXED_TAIL),
        ("startswith(queue_saturation_check, 'WARNING')", L.MIXED_QUEUE),
        (f"{early} AND {cost} < -10 AND {fast} > 0", L.EARLY_POSITIVE),
        (f"{early} AND {cost} > 20", L.EARLY_NEGATIVE),
        (early, L.NEED_14_DAYS),
        (f"{_subsecond(limits)} AND NOT {_busy(limits)}", L.INCONCLUSIVE_SUBSECOND),
        (f"{cost_high} <= 0 AND {fast_low} >= 35", L.STRONGLY_FAVORABLE),
        (f"{cost_high} <= 0 AND {fast} >= -20", L.FAVORABLE_NEUTRAL),
        (f"{cost_high} <= 0", L.MIXED_SLOWER),
        (f"{cost_high} <= 5 AND {fast_low} >= 26", L.FAVORABLE_NEAR_BREAKEVEN),
        (f"{cost_high} <= 15 AND {fast_low} >= 35", L.FAVORABLE_OFFSET),
        (f"{spend} AND {cost_low} > 5", L.MIXED_SPEND),
        (
            f"startswith(tail_latency_check, 'IMPROVED') AND {cost_high} <= 10 AND {fast} >= 0",
            L.FAVORABLE_TAIL,
        ),
        (f"{cost_low} > 15 AND {fast} < 20", L.UNFAVORABLE_COST),
        (
            f"{cost_low} > 10 AND startswith(cost_significance, 'SIGNIFICANT') AND {fast} < 20",
            L.UNFAVORABLE_CONFIRMED,
        ),
        (f"{fast_high} < 20 AND {cost_low} > 5", L.UNFAVORABLE_NEITHER),
    ]
    return labelled(rules, L.MIXED_REVIEW)


def _joined(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _shown_or(name: str, missing: str) -> str:
    return f"coalesce({shown(name, 2)}, '{missing}')"


EXTRA_CREDITS = "(gen2_daily_credits * cost_change_pct / 100D)"


def _spend_text(limits: Thresholds) -> str:
    per_year = f"{EXTRA_CREDITS} * {number(limits.price_per_credit * 365)}"
    return _joined(
        "'about '", shown("gen2_daily_credits", 0), "' credits a day, '",
        shown("cost_change_pct", 1), "'% dearer per query: about '",
        shown(EXTRA_CREDITS, 1), "' more credits a day, or $'", shown(per_year, 0),
        f"' a year at ${limits.price_per_credit:g} per credit'",
    )


MEDIANS = f"{shown('gen1_daily_median_sec', 2)}, 's → ', {shown('gen2_daily_median_sec', 2)}, 's'"


def _assessment_texts(limits: Thresholds) -> dict[str, str]:
    return {
        L.INSUFFICIENT_DATA: "Under a week of data after the change.",
        L.UNFAVORABLE_RELIABILITY: "Queries fail clearly more often; this outweighs speed and cost.",
        L.MIXED_RELIABILITY: _joined(
            "'Queries fail slightly more often ('", "reliability_status", "'). See the error analysis.'"
        ),
        L.MIXED_TAIL: "The slowest one percent takes over twice as long, whatever the median does.",
        L.MIXED_QUEUE: "Queries wait over twice as long before they start; check concurrency settings.",
        L.EARLY_POSITIVE: "First two weeks: cheaper by over 10% and faster. Confirm with more days.",
        L.EARLY_NEGATIVE: "First two weeks: over 20% dearer per query. Watch closely.",
        L.NEED_14_DAYS: "One to two weeks of data and no clear signal yet.",
        L.INCONCLUSIVE_SUBSECOND: _joined(
            "'Median under a second ('", MEDIANS, "') at about '", shown(PER_DAY_AFTER, 0),
            "' queries a day: fixed overhead dominates, so the speedup says little.'",
        ),
        L.STRONGLY_FAVORABLE: "No dearer even at worst, and at least 35% faster even at worst.",
        L.FAVORABLE_NEUTRAL: "No dearer per query even at worst, and not much slower.",
        L.MIXED_SLOWER: "No dearer per query, but more than 20% slower (or speed unknown).",
        L.FAVORABLE_NEAR_BREAKEVEN: "At worst 5% dearer per query and at worst 26% faster.",
        L.FAVORABLE_OFFSET: "At worst 15% dearer per query, which at least 35% speedup makes up for.",
        L.MIXED_SPEND: _joined("'Much is spent here: '", _spend_text(limits), "'.'"),
        L.FAVORABLE_TAIL: _joined(
            "'The slowest one percent became a fifth faster at an acceptable cost; median speedup '",
            shown("speedup_pct", 1), "'%.'",
        ),
        L.UNFAVORABLE_COST: "Over 15% dearer per query even at best, with under 20% speedup.",
        L.UNFAVORABLE_CONFIRMED: "Significantly dearer per query, over 10% at best, with under 20% speedup.",
        L.UNFAVORABLE_NEITHER: "Under 20% faster at best and over 5% dearer at best.",
        L.MIXED_REVIEW: "The signals disagree or the intervals are too wide. Read the single reports.",
    }


def _reasoning(limits: Thresholds) -> str:
    """Summary with figures, and up to three notes."""
    subsecond = first_match(
        [
            (
                f"{_subsecond(limits)} AND {_busy(limits)}",
                _joined("' Note: medians under a second, but about '", shown(PER_DAY_AFTER, 0),
                        "' queries a day add up.'"),
            ),
            (
                _subsecond(limits),
                text(" Note: medians under a second; the speedup may be overhead noise."),
            ),
        ],
        "''",
    )
    volume = first_match(
        [
            (
                f"{PER_DAY_AFTER} > {PER_DAY_BEFORE} * 1.10D",
                _joined("' Note: daily volume rose by about '",
                        shown(f"({ratio(PER_DAY_AFTER, PER_DAY_BEFORE)} - 1) * 100", 0), "'% ('",
                        shown(PER_DAY_BEFORE, 0), "' → '", shown(PER_DAY_AFTER, 0), "' queries).'"),
            )
        ],
        "''",
    )
    spend = first_match(
        [
            (
                f"gen2_daily_credits > {number(limits.high_spend_credits_per_day)} AND cost_change_pct > 5",
                _joined("' Note: '", _spend_text(limits), "'.'"),
            )
        ],
        "''",
    )
    summary = _joined(
        "gen2_days", "' days after the change against '", "gen1_days", "' before. Speedup '",
        _shown_or("speedup_pct", "N/A"), "'% ['", _shown_or("speedup_lower_bound", "?"), "'%, '",
        _shown_or("speedup_upper_bound", "?"), "'%], median '", MEDIANS, "' (difference '",
        shown("gen1_daily_median_sec - gen2_daily_median_sec", 2), "'s). Cost per query '",
        _shown_or("cost_change_pct", "N/A"), "'% ['", _shown_or("cost_change_lower_bound", "?"),
        "'%, '", _shown_or("cost_change_upper_bound", "?"), "'%], per pattern query '",
        _shown_or("pattern_cost_change_pct", "N/A"), "'%. '", "breakeven_status", "'. '",
        "reliability_status", "'.'", subsecond, volume, spend,
    )
    return first_match(
        [
            ("gen2_days < 7", _joined("'At least 7 days are needed, there are '", "gen2_days", "'.'")),
            ("gen2_days < 14", _joined("'There are '", "gen2_days", "' days; wait for 14 or more.'")),
        ],
        summary,
    )


def assess(found: DataFrame, limits: Thresholds) -> DataFrame:
    """Add assessment and texts to ``signals`` rows."""
    labels = {
        "data_quality": data_quality("gen2_days"),
        "coverage_label": pattern_coverage("gen1_pattern_coverage_pct", "gen2_pattern_coverage_pct"),
        "median_diff_sec": rounded("gen1_daily_median_sec - gen2_daily_median_sec", 4),
        "gen2_avg_daily_queries": rounded(PER_DAY_AFTER, 0),
        "assessment": assessment(limits),
        "reasoning": _reasoning(limits),
    }
    texts = {
        "data_quality_explanation": X.explain("data_quality", X.DATA_QUALITY),
        "pattern_coverage_assessment": _joined(
            "coverage_label", "': '", X.explain("coverage_label", X.COVERAGE)
        ),
        "assessment_explanation": X.explain("assessment", _assessment_texts(limits)),
    }
    return add(add(found, labels), texts)


def migration_decision(w: Workload) -> DataFrame:
    """The assessment: one row (per key) with its signals, reasons and method."""
    cfg = w.cfg
    return assess(signals(w), cfg.thresholds).selectExpr(
        *cfg.keys,
        f"{text(cfg.scope_like or EVERYTHING)} AS domain_pattern",
        f"{day(cfg.cutover)} AS cutover_date",
        "gen1_days",
        "gen2_days",
        "data_quality",
        "data_quality_explanation",
        "gen1_pattern_coverage_pct",
        "gen2_pattern_coverage_pct",
        "pattern_coverage_assessment",
        "speedup_pct",
        "speedup_lower_bound",
        "speedup_upper_bound",
        "perf_significance",
        "tail_latency_check",
        "queue_saturation_check",
        "gen1_daily_median_sec",
        "gen2_daily_median_sec",
        "median_diff_sec",
        "gen2_avg_daily_queries",
        "cost_change_pct",
        "cost_change_lower_bound",
        "cost_change_upper_bound",
        "cost_significance",
        "breakeven_status",
        "pattern_cost_change_pct",
        "pattern_cost_change_lower_bound",
        "pattern_cost_change_upper_bound",
        "pattern_cost_significance",
        "gen1_success_rate",
        "gen2_success_rate",
        "success_rate_diff_pp",
        "reliability_status",
        "assessment",
        "assessment_explanation",
        "reasoning",
        f"{text(X.METHODOLOGY)} AS metric_methodology",
        "current_timestamp() AS last_updated",
    )
