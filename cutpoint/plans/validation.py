"""Data validation: is there enough to compare?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutpoint.functions import explanations as X
from cutpoint.functions.ladders import data_sufficiency
from cutpoint.functions.numeric import percent, rounded
from cutpoint.operators.compare import add, per_period
from cutpoint.operators.daily import with_calendar
from cutpoint.operators.scope import in_scope, in_window, period_label
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by, join_by


def data_validation(w: Workload) -> DataFrame:
    """One row per period (and key): coverage in days, runs, patterns and credits."""
    cfg = w.cfg
    keys = [*cfg.keys]
    by = [*keys, "period_type"]
    per_day = group_by(
        w.count_days,
        by,
        [
            "count(activity_date) AS query_days",
            "sum(total_queries) AS total_queries",
            "sum(success_count) AS successful_queries",
            "min(activity_date) AS first_date",
            "max(activity_date) AS last_date",
            "sum(pattern_queries) AS pattern_queries",
            "sum(cached_queries) AS cached_queries",
        ],
    )
    warehouses = group_by(
        with_calendar(w.counts, cfg).selectExpr(*by, "warehouse_name AS name"),
        by,
        ["count(DISTINCT name) AS warehouse_count"],
    )
    credits = group_by(
        w.metering.where(f"{in_window(cfg)} AND {in_scope(cfg)}").selectExpr(
            *keys, f"{period_label(cfg)} AS period_type", "credits_used"
        ),
        by,
        ["CAST(round(sum(credits_used), 2) AS DOUBLE) AS total_credits"],
    )
    patterns = group_by(w.matched_patterns, keys, ["count(pattern_hash) AS common_patterns"])
    joined = join_by(join_by(per_day, warehouses, keys, by, "left"), credits, keys, by, "left")
    joined = join_by(joined, patterns, keys, keys, "left") if keys else joined.crossJoin(patterns)
    label = {"data_sufficiency": data_sufficiency("period_type", "query_days")}
    return add(joined, label).selectExpr(
        *by,
        "query_days",
        "warehouse_count",
        "total_queries",
        "successful_queries",
        f"{rounded(percent('successful_queries', 'total_queries'), 2)} AS success_rate_pct",
        "first_date",
        "last_date",
        "total_credits",
        "coalesce(common_patterns, 0) AS common_patterns",
        f"{rounded(percent('pattern_queries', 'total_queries'), 1)} AS pattern_coverage_pct",
        "cached_queries",
        f"{rounded(percent('cached_queries', 'total_queries'), 1)} AS cache_hit_rate_pct",
        "data_sufficiency",
        f"{X.explain('data_sufficiency', X.SUFFICIENCY)} AS data_sufficiency_explanation",
    ).orderBy(*keys, F.desc("period_type"))


def volume_moments() -> list[str]:
    """The period figures that the decision takes from the validation."""
    return [
        *per_period("query_days", "count", "total_queries"),
        *per_period("all_queries", "sum", "total_queries"),
        *per_period("matched_queries", "sum", "pattern_queries"),
    ]


def volume_results() -> dict[str, str]:
    return {
        f"{s}_coverage": rounded(percent(f"{s}_matched_queries", f"{s}_all_queries"), 1)
        for s in ("b", "g")
    }
