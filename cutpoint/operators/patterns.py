"""Query patterns that occur in both periods, and marking fact rows with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cutpoint.config import Config, Tuning
from cutpoint.operators.scope import PATTERN, in_scope, in_window, is_after
from cutpoint.session import group_by, join_by, query

IN_BOTH = "gen1_runs > 0 AND gen2_runs > 0"
# What a row of a broadcast takes besides its text.
ROW_BYTES = 64


def pattern_presence(query_history: DataFrame, cfg: Config) -> DataFrame:
    """One row per pattern (and key) with its runs in each period.

    One pass, combined on the map side, so a pattern with a third of all rows costs its shuffle
    partition one row per map task. Cached and failed runs count: presence is all that matters.
    """
    rows = query_history.where(f"{in_window(cfg)} AND {in_scope(cfg)} AND {PATTERN} IS NOT NULL")
    return group_by(
        rows,
        [*cfg.keys, PATTERN],
        [
            f"count_if(NOT {is_after(cfg)}) AS gen1_runs",
            f"count_if({is_after(cfg)}) AS gen2_runs",
        ],
    )


def matched_only(presence: DataFrame) -> DataFrame:
    """Patterns of both periods: the intersection of the two periods' pattern sets."""
    return presence.where(IN_BOTH)


def mark_matched(
    rows: DataFrame, presence: DataFrame, cfg: Config, matched: str = IN_BOTH
) -> DataFrame:
    """Add ``is_pattern``. ``presence`` must be settled: it is measured here, then joined.

    ``matched`` is the condition on ``presence`` that a pattern must meet. A matched set within the broadcast limits leaves the fact rows where they are. A larger one is
    joined by a shuffle in which no pattern can overload a partition, see ``_mark_by_shuffle``.
    """
    on = [*cfg.keys, PATTERN]
    width = " + ".join(f"coalesce(octet_length(CAST({c} AS STRING)), 0)" for c in on)
    measured = _measured(presence, matched, width)
    flags = presence.where(matched).selectExpr(*on, "true AS matched_flag")
    limits = cfg.tuning
    n_matched, n_bytes = sum(m["matched"] for m in measured), sum(m["bytes"] for m in measured)
    if n_matched <= limits.broadcast_max_rows and n_bytes <= limits.broadcast_max_bytes:
        marked = join_by(rows, flags, cfg.keys, on, "left", "broadcast")
    else:
        marked = _mark_by_shuffle(rows, presence, flags, cfg.keys, shuffle_plan(measured, limits), matched)
    return marked.selectExpr(*rows.columns, "coalesce(matched_flag, false) AS is_pattern")


def _measured(presence: DataFrame, matched: str, width: str) -> list[Row]:
    """Patterns by the power of two of their runs: at most 64 rows, whatever the number of patterns."""
    return query(
        f"""SELECT length(bin(gen1_runs + gen2_runs)) AS magnitude, count(*) AS patterns, sum(gen1_runs + gen2_runs) AS runs,
                   count_if({matched}) AS matched,
                   coalesce(sum(CASE WHEN {matched} THEN {width} + {ROW_BYTES} END), 0) AS bytes
            FROM {{presence}} GROUP BY 1""",
        presence=presence,
    ).collect()


@dataclass(frozen=True)
class ShufflePlan:
    """How many partitions, and the runs from which a pattern is spread over all of them."""

    partitions: int
    frequent: int


def shuffle_plan(measured: list[Row], limits: Tuning) -> ShufflePlan:
    """Partitions by the measured runs and bytes; the most frequent patterns, no more than partitions, are spread.

    ``measured`` holds patterns, runs and bytes by magnitude (number of binary digits of the runs).
    """
    runs, size = sum(m["runs"] for m in measured), sum(m["bytes"] for m in measured)
    partitions = max(1, -(-runs // limits.shuffle_rows), -(-size // limits.shuffle_bytes))
    # From the top down, as long as they stay a broadcast of no more rows than partitions.
    frequent, spread = 1 << 63, 0
    for m in sorted(measured, key=lambda m: -m["magnitude"]):
        spread += m["patterns"]
        if spread > partitions:
            break
        frequent = 1 << (m["magnitude"] - 1)
    # A magnitude of more patterns than that is cut where fewer than ``partitions`` can lie: at a partition's share.
    share = -(-runs // partitions)
    return ShufflePlan(partitions, min(frequent, max(2, share)))


def _mark_by_shuffle(
    rows: DataFrame, presence: DataFrame, flags: DataFrame, keys: Sequence[str], plan: ShufflePlan, matched: str
) -> DataFrame:
    """Shuffle join in which only patterns with a small share of the rows meet by key.

    The frequent patterns are answered by a broadcast of about as many rows as there are partitions; they, and rows
    without a pattern, are then spread over all partitions by a hash of the row instead of their key. The
    other side has one row per pattern, which hashes evenly. Both sides are dealt into the measured number of
    partitions. The join sorts and merges, so that a partition's part of the patterns may be larger than a
    task's memory: it spills.
    """
    on = [*keys, PATTERN]
    frequent = presence.where(f"gen1_runs + gen2_runs >= {plan.frequent}").selectExpr(*on, f"({matched}) AS frequent_flag")
    others = ", ".join(c for c in rows.columns if c not in on)
    # More slots than partitions, so that their uneven placement evens out. The slot of a joined row
    # is a function of its key on both sides: a constant would be folded out of the join keys and
    # the rows spread by slot would meet by pattern again.
    slots = plan.partitions * 16
    by_key = f"pmod(xxhash64({', '.join(on)}), {slots})"
    by_row = f"-1 - pmod(xxhash64({others}), {slots})"
    placed = join_by(rows, frequent, keys, on, "left", "broadcast").selectExpr(
        "*",
        f"CASE WHEN frequent_flag IS NOT NULL OR {PATTERN} IS NULL THEN {by_row}"
        f" ELSE {by_key} END AS slot",
    )
    # One column to meet by: fields that are NULL are equal in it, and both sides are dealt by it alone. A spread
    # row meets nothing, so it leaves its pattern out and isn't drawn together by it.
    met = f"struct({', '.join(f'CASE WHEN slot >= 0 THEN {c} END AS {c}' for c in on)}, slot)"
    placed = placed.withColumn("met", F.expr(met)).repartition(plan.partitions, "met")
    slotted = flags.selectExpr("*", f"{by_key} AS slot").selectExpr("matched_flag", f"{met} AS other")
    slotted = slotted.repartition(plan.partitions, "other")
    return placed.join(slotted.hint("merge"), F.expr("met = other"), "left").selectExpr(
        *rows.columns, "coalesce(frequent_flag, matched_flag) AS matched_flag"
    )
