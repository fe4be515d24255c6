"""Rule ladders: the first rule that is true gives the label; NULL comparisons fall through."""

from __future__ import annotations

from cutpoint.config import GEN1, GEN2, Thresholds
from cutpoint.functions import labels as L
from cutpoint.functions.numeric import labelled, ratio
from cutpoint.functions.welch import INSUFFICIENT_DF, MIN_DF


def data_sufficiency(period: str, days: str) -> str:
    after, before = f"{period} = '{GEN2}'", f"{period} = '{GEN1}'"
    return labelled(
        [
            (f"{after} AND {days} < 7", L.GEN2_CRITICAL),
            (f"{after} AND {days} < 14", L.GEN2_WARNING),
            (f"{after} AND {days} >= 14", L.GEN2_OK),
            (f"{before} AND {days} < 14", L.GEN1_CRITICAL),
            (f"{before} AND {days} < 30", L.GEN1_WARNING),
            (f"{before} AND {days} >= 30", L.GEN1_OK),
        ],
        L.OK,
    )


def tail_latency(before: str, after: str) -> str:
    """On the mean daily P99 of each period."""
    return labelled(
        [
            (f"{after} > {before} * 2", L.TAIL_WARNING),
            (f"{after} > {before} * 1.5D", L.TAIL_CAUTION),
            (f"{after} <= {before} * 0.8D", L.TAIL_IMPROVED),
        ],
        L.OK,
    )


def queue_saturation(before: str, after: str) -> str:
    """On the mean daily P95 queue seconds. A base under one second counts as one second."""
    base = f"(CASE WHEN {before} IS NOT NULL THEN greatest({before}, 1D) END)"
    return labelled(
        [
            (f"{before} < 0.1D AND {after} < 0.1D", L.QUEUE_NEGLIGIBLE),
            (f"{after} > {base} * 2", L.QUEUE_WARNING),
            (f"{after} > {base} * 1.5D", L.QUEUE_CAUTION),
            (f"{before} > 1 AND {after} <= {before} * 0.8D", L.QUEUE_IMPROVED),
        ],
        L.OK,
    )


def breakeven(cost_change: str) -> str:
    """An unknown change takes the last label."""
    return labelled(
        [
            (f"{cost_change} <= 0", L.COST_LOWER),
            (f"{cost_change} <= 5", L.COST_NEUTRAL),
            (f"{cost_change} <= 15", L.COST_HIGHER),
        ],
        L.COST_MUCH_HIGHER,
    )


def cost_consistency(all_gap: str, pattern_gap: str) -> str:
    """On the gaps between average and weighted cost change, in percentage points."""
    return labelled(
        [
            (f"{all_gap} > 10 OR {pattern_gap} > 10", L.DIVERGENCE_WARNING),
            (f"{all_gap} > 5 OR {pattern_gap} > 5", L.DIVERGENCE_NOTICE),
        ],
        L.DIVERGENCE_OK,
    )


def reliability(
    t: str, df: str, t95: str, t90: str, before: str, after: str, limits: Thresholds
) -> str:
    """On the Welch test of the daily rates; the effect size is that of the overall rates."""
    failure_change = f"abs({ratio(f'({before} - {after})', f'(100D - {before})')}) * 100"
    large = (
        f"(abs({after} - {before}) >= {limits.reliability_drop_pp}D"
        f" OR {failure_change} > {limits.reliability_failure_increase_pct}D)"
    )
    below_95 = f"{t} < -{t95}"
    return labelled(
        [
            (f"{df} < {MIN_DF}", INSUFFICIENT_DF),
            (f"{below_95} AND {large}", L.DEGRADED),
            (below_95, L.MINOR_05),
            (f"{t} < -{t90}", L.MINOR_10),
        ],
        L.NO_DEGRADATION,
    )


def error_trend(is_new: str, before: str, after: str) -> str:
    """On the errors per query of each period."""
    return labelled(
        [
            (is_new, L.NEW_ERROR),
            (f"{after} > {before} * 2.0D", L.RATE_DOUBLED),
            (f"{after} > {before} * 1.5D", L.RATE_UP_50),
            (f"{after} > {before} * 1.2D", L.RATE_UP_20),
            (f"{after} > {before} * 1.15D", L.RATE_UP_15),
            (f"{after} > {before} * 1.10D", L.RATE_UP_10),
            (f"{after} > {before} * 1.05D", L.RATE_UP_5),
            (f"{after} < {before} * 0.95D", L.RATE_DOWN_5),
        ],
        L.RATE_STABLE,
    )


def pattern_status(before: str, after: str) -> str:
    """On the rounded median seconds of each period."""
    return labelled(
        [(f"{after} > {before} * 1.20D", L.REGRESSION), (f"{after} < {before} * 0.80D", L.IMPROVEMENT)],
        L.STABLE,
    )


def data_quality(days: str) -> str:
    return labelled(
        [
            (f"{days} < 7", L.QUALITY_CRITICAL),
            (f"{days} < 14", L.QUALITY_PRELIMINARY),
            (f"{days} < 21", L.QUALITY_ADEQUATE),
        ],
        L.QUALITY_STRONG,
    )


def pattern_coverage(before: str, after: str) -> str:
    """On the lower of the two coverages; an unknown one counts as none."""
    lower = f"least(coalesce({before}, 0D), coalesce({after}, 0D))"
    return labelled([(f"{lower} >= 90", L.COVERAGE_HIGH), (f"{lower} >= 70", L.COVERAGE_MODERATE)], L.COVERAGE_LOW)
