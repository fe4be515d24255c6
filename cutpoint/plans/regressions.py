"""Pattern report: which recurring queries became slower or faster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutpoint.functions import explanations as X
from cutpoint.functions.ladders import pattern_status
from cutpoint.functions.numeric import rounded, speedup_pct, text
from cutpoint.operators.compare import PERIODS, per_period
from cutpoint.operators.daily import seconds
from cutpoint.operators.patterns import mark_matched
from cutpoint.operators.quantiles import exact_percentiles
from cutpoint.operators.samples import SAMPLE_TEXT, first_samples, only_values
from cutpoint.operators.scope import DID_WORK, PATTERN, SUCCEEDED, only_days, period_label
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by, join_by, settle


def _compared_runs(w: Workload) -> DataFrame:
    """Successful runs of any pattern that did work."""
    return w.rows.where(f"{DID_WORK} AND {SUCCEEDED} AND {PATTERN} IS NOT NULL")


def _compared(w: Workload) -> DataFrame:
    """Patterns with enough runs in both periods: times, ladders and first day; no samples, no order.

    A pattern's presence counts all of its runs, so patterns whose presence is too small in a period
    drop out before anything is shuffled. The rest is reduced to (pattern, period, milliseconds) counts
    before it is grouped by pattern, so a pattern with a third of all runs is spread over its distinct
    times. The counts are settled: three steps read them.
    """
    cfg = w.cfg
    by = [*cfg.keys, "pattern_hash"]
    least = cfg.thresholds.min_pattern_runs
    enough = f"gen1_runs >= {least} AND gen2_runs >= {least}"
    needed = [*cfg.keys, PATTERN, "activity_date", "execution_time"]
    marked = mark_matched(_compared_runs(w).select(*needed), w.presence, cfg, enough)
    runs = marked.where("is_pattern").selectExpr(
        *cfg.keys,
        f"{PATTERN} AS pattern_hash",
        f"{period_label(cfg)} AS period_type",
        "CAST(execution_time AS BIGINT) AS ms",
        "activity_date",
    )
    hist = settle(
        group_by(runs, [*by, "period_type", "ms"], ["count(1) AS n", "min(activity_date) AS first_day"])
    )
    first_day, _ = per_period("first_day", "min", "first_day")
    counts = group_by(hist, by, [*per_period("runs", "sum", "n"), first_day]).where(
        f"b_runs >= {least} AND g_runs >= {least}"
    )
    found = exact_percentiles(hist, [*by, "period_type"], "ms", [5, 50, 95], keys=cfg.keys)
    times = group_by(
        found, by, [a for p in (5, 50, 95) for a in per_period(str(p), "max", f"p{p}_x100")]
    ).selectExpr(
        *by,
        *[f"{rounded(seconds(f'{s}_{p}'), 4)} AS {s}_{p}" for s in PERIODS for p in (5, 50, 95)],
    )
    return join_by(counts, times, cfg.keys, by, "left").selectExpr(
        *by,
        "b_runs AS gen1_count",
        "g_runs AS gen2_count",
        "b_50 AS gen1_median_sec",
        "g_50 AS gen2_median_sec",
        f"{rounded(speedup_pct('b_50', 'g_50'), 1)} AS speedup_pct",
        "b_95 AS gen1_p95_sec",
        "g_95 AS gen2_p95_sec",
        "b_5 AS gen1_05_sec",
        "g_5 AS gen2_05_sec",
        f"{rounded(speedup_pct('b_95', 'g_95'), 1)} AS p95_speedup_pct",
        f"{rounded('g_runs * abs(g_50 - b_50)', 2)} AS impact_score",
        f"{pattern_status('b_50', 'g_50')} AS status",
        "b_first_day AS first_day",
    )


def _with_samples(w: Workload, patterns: DataFrame, *, few: bool) -> DataFrame:
    """Add a text and a warehouse of each pattern, taken from its first day before the change.

    Recurring patterns mostly appear in the first days, so the wide text column is read for few
    days. ``few`` says that ``patterns`` was cut by a limit and may be broadcast: its rows are then also
    looked for by value, which staged tables answer by their Bloom filters and order. Otherwise the
    texts are combined per pattern and day before they are shuffled.
    """
    cfg = w.cfg
    by = [*cfg.keys, "pattern_hash"]
    first_days = patterns.selectExpr(*by, "first_day AS activity_date")
    if cfg.first_run_samples:
        samples = first_samples(_compared_runs(w), first_days, cfg, PATTERN, "pattern_hash")
    else:
        samples = _least_samples(w, first_days, few=few)
    columns = [c for c in patterns.columns if c not in (*by, "first_day")]
    return join_by(patterns, samples, cfg.keys, by, "left").selectExpr(
        *by,
        "sample_query",
        "sample_warehouse",
        *columns,
        f"{X.explain('status', X.PATTERN_STATUS)} AS status_explanation",
    )


def _least_samples(w: Workload, first_days: DataFrame, *, few: bool) -> DataFrame:
    """The smallest text and the smallest warehouse of each pattern's first day."""
    cfg = w.cfg
    by = [*cfg.keys, "pattern_hash"]
    on = [*by, "activity_date"]
    runs = only_days(_compared_runs(w), first_days)
    if few:
        runs = only_values(runs, PATTERN, first_days, "pattern_hash", cfg.tuning.lookup_values)
    texts = runs.selectExpr(
        *cfg.keys,
        f"{PATTERN} AS pattern_hash",
        "activity_date",
        f"{SAMPLE_TEXT} AS sample",
        "warehouse_name AS warehouse",
    )
    sample = ["min(sample) AS sample_query", "min(warehouse) AS sample_warehouse"]
    if few:
        return group_by(join_by(texts, first_days, cfg.keys, on, hint="broadcast"), by, sample)
    return join_by(group_by(texts, on, sample), first_days, cfg.keys, on).drop("activity_date")


def pattern_regressions(w: Workload) -> DataFrame:
    """Every comparable pattern, largest impact (runs × seconds changed) first.

    The comparison is settled first: it is read once for the days of the samples and once for the
    result.
    """
    patterns = settle(_compared(w))
    return _with_samples(w, patterns, few=False).orderBy(
        *w.cfg.keys, F.desc("impact_score"), "pattern_hash"
    )


def top_patterns(w: Workload, status: str, limit: int = 20) -> DataFrame:
    """The patterns of one status with the largest impact. Samples are fetched for those only."""
    order = [F.desc("impact_score"), F.asc("pattern_hash")]
    top = settle(_compared(w).where(f"status = {text(status)}").orderBy(*order).limit(limit))
    return _with_samples(w, top, few=True).orderBy(*order)
