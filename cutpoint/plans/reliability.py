"""Reliability reports: the test of daily success rates, and error statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.config import GEN2
from cutpoint.functions import explanations as X
from cutpoint.functions import labels as L
from cutpoint.functions.ladders import error_trend
from cutpoint.functions.ladders import reliability as reliability_status
from cutpoint.functions.numeric import percent, ratio, rounded, shown
from cutpoint.functions.welch import INSUFFICIENT_DF, drop_significance
from cutpoint.operators.compare import add, in_both_periods, moments, per_period, tested, with_welch
from cutpoint.operators.samples import SAMPLE_TEXT, first_samples
from cutpoint.operators.scope import FAILED, SUCCEEDED, only_days, period_label
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by, join_by, settle

def success_daily(w: Workload) -> DataFrame:
    """Success rate of every run of each day: a cached success is a success.

    One narrow pass, which a shared workload has behind it already.
    """
    columns = [*w.cfg.keys, "activity_date", "period_type", "total_queries", "success_count"]
    if w.share:
        return w.query_days.select(*columns, "daily_success_rate_pct")
    days = group_by(
        w.rows,
        [*w.cfg.keys, "activity_date"],
        ["count(1) AS total_queries", f"count_if({SUCCEEDED}) AS success_count"],
    )
    return add(days, {"period_type": period_label(w.cfg)}).selectExpr(
        *columns,
        f"{rounded(percent('success_count', 'total_queries'), 4)} AS daily_success_rate_pct",
    )


def reliability_moments() -> list[str]:
    """Period aggregates over days behind the reliability test."""
    return [
        *moments("rate", "daily_success_rate_pct"),
        *per_period("total", "sum", "total_queries"),
        *per_period("success", "sum", "success_count"),
    ]


def reliability_present() -> str:
    return in_both_periods("rate_n")


def reliability_rates() -> dict[str, str]:
    """Success rates of the period totals (not means of daily rates)."""
    return {f"rel_{s}": percent(f"{s}_success", f"{s}_total") for s in ("b", "g")}


def reliability_results(limits) -> dict[str, str]:
    """Over ``reliability_rates`` with the rate test added."""
    return {
        "rel_gen1_rate": rounded("rel_b", 4),
        "rel_gen2_rate": rounded("rel_g", 4),
        "rel_diff_pp": rounded("rel_g - rel_b", 4),
        "rel_status": reliability_status(*tested("rate"), "rel_b", "rel_g", limits),
    }


FAILURE_CHANGE = f"{ratio('(rel_b - rel_g)', '(100D - rel_b)')} * 100D"


def _reliability_texts() -> dict[str, str]:
    rates = f"'success rate ', {shown('rel_b', 2)}, '% → ', {shown('rel_g', 2)}, '%'"
    change = f"coalesce({shown(FAILURE_CHANGE, 1)}, 'n/a')"
    return {
        INSUFFICIENT_DF: "Too few days for a test of daily success rates.",
        L.DEGRADED: f"concat('Fails clearly more often: ', {rates}, ', failure rate change ', {change},"
        " '%. See the error analysis.')",
        L.MINOR_05: f"concat('Fails slightly but significantly more often: ', {rates}, '.')",
        L.MINOR_10: f"concat('May fail more often (10% level only): ', {rates}, '.')",
        L.NO_DEGRADATION: "No significant fall of the daily success rate.",
    }


def reliability(w: Workload) -> DataFrame:
    """Reliability test: one row (per key). Empty unless both periods have runs."""
    cfg = w.cfg
    found = group_by(success_daily(w), [*cfg.keys], reliability_moments()).where(reliability_present())
    found = add(with_welch(add(found, reliability_rates()), "rate"), reliability_results(cfg.thresholds))
    return found.selectExpr(
        "'RELIABILITY' AS metric_category",
        *cfg.keys,
        "b_total AS n_gen1",
        "g_total AS n_gen2",
        "rel_gen1_rate AS gen1_success_rate",
        "rel_gen2_rate AS gen2_success_rate",
        "rel_diff_pp AS success_rate_diff_pp",
        f"{rounded('100D - rel_b', 4)} AS gen1_failure_rate_pct",
        f"{rounded('100D - rel_g', 4)} AS gen2_failure_rate_pct",
        f"{rounded('rel_b - rel_g', 4)} AS failure_rate_diff_pp",
        f"{rounded(FAILURE_CHANGE, 1)} AS failure_rate_change_pct",
        "b_rate_n AS gen1_days",
        "g_rate_n AS gen2_days",
        f"{rounded('rate_t', 3)} AS t_statistic",
        f"{rounded('rate_df', 1)} AS degrees_of_freedom",
        f"{drop_significance(*tested('rate'))} AS significance",
        "rel_status AS reliability_status",
        f"{X.explain('rel_status', _reliability_texts())} AS reliability_explanation",
    )


def error_analysis(w: Workload) -> DataFrame:
    """Error statuses seen after the change, against before.

    One pass reduces the runs to (day, status) counts, which are settled; totals and errors of both
    periods are read off those. Sample texts come from a second pass over each status's first day
    only, so the wide text column of the other days is not read.
    """
    cfg = w.cfg
    keys = [*cfg.keys]
    counts = group_by(w.rows, [*keys, "activity_date", "execution_status"], ["count(1) AS n"])
    days = add(settle(counts), {"period_type": period_label(cfg)})
    totals = group_by(
        group_by(days, [*keys, "activity_date", "period_type"], ["sum(n) AS n"]),
        keys,
        [*per_period("total", "sum", "n"), *per_period("days", "count", "1")],
    )
    errors = group_by(
        days.where(FAILED),
        [*keys, "execution_status"],
        [
            *per_period("errors", "sum", "n"),
            f"min(CASE WHEN period_type = '{GEN2}' THEN activity_date END) AS first_seen",
            f"max(CASE WHEN period_type = '{GEN2}' THEN activity_date END) AS last_seen",
        ],
    ).where("g_errors IS NOT NULL")
    on = [*keys, "execution_status", "activity_date"]
    first_days = errors.selectExpr(*keys, "execution_status", "first_seen AS activity_date")
    if cfg.first_run_samples:
        samples = first_samples(w.rows.where(FAILED), first_days, cfg, "execution_status", "execution_status")
        samples = samples.drop("sample_warehouse")
    else:
        texts = only_days(w.rows.where(FAILED), first_days).selectExpr(*on, f"{SAMPLE_TEXT} AS sample")
        samples = join_by(group_by(texts, on, ["min(sample) AS sample_query"]), first_days, keys, on).drop("activity_date")
    joined = join_by(errors, totals, keys, keys) if keys else errors.crossJoin(totals)
    joined = join_by(joined, samples, keys, [*keys, "execution_status"], "left")
    rates = {
        "b_count": "coalesce(b_errors, 0)",
        "b_rate": ratio("coalesce(b_errors, 0)", "b_total"),
        "g_rate": ratio("g_errors", "g_total"),
        "error_trend": error_trend(
            "b_errors IS NULL",
            ratio("coalesce(b_errors, 0)", "b_total"),
            ratio("g_errors", "g_total"),
        ),
    }
    return add(joined, rates).selectExpr(
        *keys,
        "execution_status",
        "b_count AS gen1_error_count",
        "g_errors AS gen2_error_count",
        f"{rounded(ratio('b_count * 1000D', 'b_total'), 4)} AS gen1_errors_per_1000_queries",
        f"{rounded(ratio('g_errors * 1000D', 'g_total'), 4)} AS gen2_errors_per_1000_queries",
        f"{rounded(percent('g_rate - b_rate', 'b_rate'), 1)} AS per_query_rate_change_pct",
        f"{rounded(ratio('b_count', 'b_days'), 2)} AS gen1_errors_per_day",
        f"{rounded(ratio('g_errors', 'g_days'), 2)} AS gen2_errors_per_day",
        "coalesce(b_total, 0) AS gen1_total_queries",
        "g_total AS gen2_total_queries",
        f"{rounded(ratio('g_total', 'g_days'), 1)} AS gen2_queries_per_day",
        f"{rounded(ratio('b_total', 'b_days'), 1)} AS gen1_queries_per_day",
        "first_seen",
        "last_seen",
        "sample_query",
        "error_trend",
        f"{X.explain('error_trend', X.ERROR_TREND)} AS error_trend_explanation",
    ).orderBy(*keys, "gen2_errors_per_1000_queries", "execution_status", ascending=[True] * len(keys) + [False, True])
