"""Exact interpolated percentiles of whole numbers, spread over many tasks per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutpoint.session import group_by, join_by, listed, query

# Values per bucket. With milliseconds a bucket is one second.
BUCKET_WIDTH = 1000


def exact_percentiles(
    hist: DataFrame,
    group: list[str],
    value: str,
    percents: list[int],
    *,
    few_groups: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """PERCENTILE_CONT for each whole percent p over a histogram: rows (group, value, n).

    The histogram is made by the caller with one aggregate by group *and* value, which combines on
    the map side and spreads even a group with a third of all rows over its values.

    Output per group: ``n_values``, ``sum_values`` and per percent

    * ``p{p}_x100``: the interpolated percentile times 100, exact as a bigint,
    * ``below{p}_n`` / ``below{p}_sum``: count and sum of the values under the percentile.

    Two levels keep every task small. Bucket totals say which bucket holds each rank (rows per
    group: at most the value range / BUCKET_WIDTH); only those buckets are then sorted by value
    (rows per bucket: at most BUCKET_WIDTH). No step holds a group's rows, or its distinct values,
    in one place. ``few_groups`` states that the number of groups is bounded by the configuration
    (days, weekdays), which bounds the bucket list that is then broadcast; otherwise the planner
    joins by shuffle on (group, bucket).

    NULL values are left out. A group without values gives no row, nor does one with NULL in a column
    of ``group`` that ``keys`` doesn't name.
    """
    by = listed(*group)
    values = hist.where(f"{value} IS NOT NULL").selectExpr(
        *group, f"{value} AS v", "n", f"floor({value} / {BUCKET_WIDTH}) AS bucket"
    )
    totals = group_by(
        values, [*group, "bucket"], ["sum(n) AS bucket_n", "sum(v * n) AS bucket_sum"]
    )
    upto = f"OVER (PARTITION BY {by} ORDER BY bucket ROWS UNBOUNDED PRECEDING)"
    buckets = query(
        f"""SELECT {by}, bucket,
                   sum(bucket_n) OVER (PARTITION BY {by}) AS n_values,
                   sum(bucket_sum) OVER (PARTITION BY {by}) AS sum_values,
                   sum(bucket_n) {upto} AS end_n,
                   sum(bucket_n) {upto} - bucket_n AS start_n,
                   sum(bucket_sum) {upto} - bucket_sum AS start_sum
            FROM {{totals}}""",
        totals=totals,
    )
    wanted = buckets.where(
        " OR ".join(
            _holds(rank, "start_n", "end_n") for p in percents for rank in (_lower(p), _upper(p))
        )
    )
    if few_groups:
        wanted = F.broadcast(wanted)

    upto = f"OVER (PARTITION BY {by}, bucket ORDER BY v ROWS UNBOUNDED PRECEDING)"
    ranked = query(
        f"""SELECT {by}, v, n_values, sum_values,
                   start_n + sum(n) {upto} AS upto_n,
                   start_n + sum(n) {upto} - n AS below_n,
                   start_sum + sum(v * n) {upto} - v * n AS below_sum
            FROM {{joined}}""",
        joined=join_by(values, wanted, keys, [*group, "bucket"]),
    )
    picks = ["first(n_values) AS n_values", "first(sum_values) AS sum_values"]
    for p in percents:
        at_lower = _holds(_lower(p), "below_n", "upto_n")
        at_upper = _holds(_upper(p), "below_n", "upto_n")
        picks += [
            f"max(CASE WHEN {at_lower} THEN v END) AS lower{p}",
            f"max(CASE WHEN {at_upper} THEN v END) AS upper{p}",
            # The values at or above the percentile start at the upper rank's value: a percentile
            # strictly between two values excludes the lower one.
            f"max(CASE WHEN {at_upper} THEN below_n END) AS below{p}_n",
            f"max(CASE WHEN {at_upper} THEN below_sum END) AS below{p}_sum",
        ]
    return group_by(ranked, group, picks).selectExpr(
        *group,
        "n_values",
        "sum_values",
        *[f"lower{p} * 100 + (upper{p} - lower{p}) * {_remainder(p)} AS p{p}_x100" for p in percents],
        *[f"below{p}_{what}" for p in percents for what in ("n", "sum")],
    )


def _position(p: int) -> str:
    """(n − 1) · p, the rank in hundredths, in whole numbers."""
    return f"((n_values - 1) * {p})"


def _remainder(p: int) -> str:
    return f"({_position(p)} % 100)"


def _lower(p: int) -> str:
    return f"({_position(p)} DIV 100)"


def _upper(p: int) -> str:
    return f"(({_position(p)} + 99) DIV 100)"


def _holds(rank: str, start: str, end: str) -> str:
    return f"({start} <= {rank} AND {rank} < {end})"
