"""All reports by name, and as temporary views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cutpoint.functions.labels import IMPROVEMENT, REGRESSION
from cutpoint.plans.cost import cost_by_dow, cost_daily, cost_welch_test, daily_trend
from cutpoint.plans.decision import migration_decision
from cutpoint.plans.performance import perf_by_dow, perf_daily, perf_summary, perf_welch_test
from cutpoint.plans.regressions import pattern_regressions, top_patterns
from cutpoint.plans.reliability import error_analysis, reliability
from cutpoint.plans.validation import data_validation
from cutpoint.plans.workload import Workload
from cutpoint.session import settle

REPORTS: dict[str, Callable[[Workload], DataFrame]] = {
    "data_validation": data_validation,
    "perf_daily": perf_daily,
    "perf_welch_test": perf_welch_test,
    "perf_by_dow": perf_by_dow,
    "perf_summary": perf_summary,
    "cost_daily": cost_daily,
    "cost_welch_test": cost_welch_test,
    "cost_by_dow": cost_by_dow,
    "reliability": reliability,
    "error_analysis": error_analysis,
    "pattern_regressions": pattern_regressions,
    "daily_trend": daily_trend,
    "migration_decision": migration_decision,
}


def top_regressions(w: Workload, limit: int = 20) -> DataFrame:
    return top_patterns(w, REGRESSION, limit)


def top_improvements(w: Workload, limit: int = 20) -> DataFrame:
    return top_patterns(w, IMPROVEMENT, limit)


def create_views(w: Workload, prefix: str = "") -> list[str]:
    """Register every report as a temporary view for SQL users.

    The results are written as tables now, so the views are one snapshot that later loads don't touch;
    call again for new ones.
    """
    names = []
    for name, report in REPORTS.items():
        settle(report(w)).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
