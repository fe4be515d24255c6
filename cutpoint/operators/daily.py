"""One row per day (and key): the observations that all tests are made on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.config import Config
from cutpoint.functions.dates import iso_weekday, weekday_name
from cutpoint.functions.numeric import percent, ratio, rounded
from cutpoint.operators.cells import EXEC, IS_COMPARABLE, QUEUE
from cutpoint.operators.quantiles import exact_percentiles
from cutpoint.operators.scope import in_scope, in_window, period_label
from cutpoint.session import full_join_by, group_by, join_by


def seconds(x100: str) -> str:
    """Hundredths of a millisecond to seconds."""
    return f"({x100} / 100000D)"


def daily_counts(kinds: DataFrame, cfg: Config) -> DataFrame:
    """Run counts per day, all scopes side by side, from counts per kind of run (``n``)."""

    def runs(condition: str, name: str) -> str:
        return f"coalesce(sum(CASE WHEN {condition} THEN n END), 0) AS {name}"

    return group_by(
        kinds,
        [*cfg.keys, "activity_date"],
        [
            "sum(n) AS total_queries",
            runs("is_success", "success_count"),
            runs("is_cached", "cached_queries"),
            runs("is_live", "live_queries"),
            runs("is_pattern", "pattern_queries"),
            runs("is_pattern AND is_live", "pattern_live_queries"),
            runs(IS_COMPARABLE, "query_count"),
        ],
    )


def daily_percentiles(cells: DataFrame, cfg: Config, *, with_queue: bool) -> DataFrame:
    """Execution and (on request) queue percentiles per day, from the same cells."""
    keys = [*cfg.keys, "activity_date"]
    group = [*keys, "measure"]
    used = f"{IS_COMPARABLE} OR measure = '{QUEUE}'" if with_queue else IS_COMPARABLE
    found = exact_percentiles(cells.where(used), group, "ms", [50, 95, 99], few_groups=not cfg.keys, keys=cfg.keys)
    if not with_queue:
        return found.drop("measure")

    def of(measure: str, name: str, alias: str) -> str:
        return f"max(CASE WHEN measure = '{measure}' THEN {name} END) AS {alias}"

    exec_columns = [c for c in found.columns if c not in group]
    return group_by(
        found,
        keys,
        [
            *[of(EXEC, c, c) for c in exec_columns],
            of(QUEUE, "p50_x100", "queue_p50_x100"),
            of(QUEUE, "p95_x100", "queue_p95_x100"),
        ],
    )


def daily_queries(cells: DataFrame, cfg: Config, *, with_queue: bool) -> DataFrame:
    """Per day with runs: counts, success rates, percentiles, tail and queue figures."""
    keys = [*cfg.keys, "activity_date"]
    counts = daily_counts(cells.where(f"measure = '{EXEC}'"), cfg)
    days = join_by(counts, daily_percentiles(cells, cfg, with_queue=with_queue), cfg.keys, keys, "left")

    def sec(x100: str, name: str) -> str:
        return f"{rounded(seconds(x100), 4)} AS {name}"

    queue = [sec("queue_p50_x100", "median_queue_sec"), sec("queue_p95_x100", "p95_queue_sec")]
    return days.selectExpr(
        *keys,
        "total_queries",
        "success_count",
        "cached_queries",
        "live_queries",
        "pattern_queries",
        "query_count",
        f"{rounded(percent('success_count', 'total_queries'), 4)} AS daily_success_rate_pct",
        sec("p50_x100", "median_exec_sec"),
        sec("p95_x100", "p95_exec_sec"),
        sec("p99_x100", "p99_exec_sec"),
        "CASE WHEN query_count > 0 THEN coalesce(n_values - below95_n, 0) END AS p95_tail_count",
        f"{rounded(percent('sum_values - below95_sum', 'sum_values'), 1)} AS p95_tail_weight_pct",
        f"{rounded(percent('query_count', 'pattern_live_queries'), 2)} AS success_rate_pct",
        *(queue if with_queue else []),
    )


def daily_metering(metering: DataFrame, cfg: Config) -> DataFrame:
    """Credits per metered day. Decimal sums do not depend on the order of the rows."""
    return group_by(
        metering.where(f"{in_window(cfg)} AND {in_scope(cfg)}"),
        [*cfg.keys, "activity_date"],
        ["CAST(round(sum(credits_used), 4) AS DOUBLE) AS daily_credits", "true AS metered"],
    )


def with_cost(queries: DataFrame, metering_days: DataFrame, cfg: Config) -> DataFrame:
    """Days with runs or metering. Cost figures exist on metered days only."""
    days = full_join_by(queries, metering_days, cfg.keys, [*cfg.keys, "activity_date"])

    def per_query(count: str, name: str) -> str:
        return f"{rounded(ratio('daily_credits', count), 6)} AS {name}"

    return days.selectExpr(
        *[c for c in days.columns if c != "metered"],
        "coalesce(metered, false) AS is_metered",
        "CASE WHEN metered THEN coalesce(live_queries, 0) END AS all_query_count",
        per_query("live_queries", "all_credits_per_query"),
        "CASE WHEN metered THEN coalesce(query_count, 0) END AS pattern_query_count",
        per_query("query_count", "wh_credits_per_pattern_query"),
    )


def with_calendar(days: DataFrame, cfg: Config) -> DataFrame:
    return days.selectExpr(
        "*",
        f"{period_label(cfg)} AS period_type",
        f"{iso_weekday('activity_date')} AS day_of_week_num",
        f"{weekday_name('activity_date')} AS day_of_week",
    )
