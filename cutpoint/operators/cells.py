"""The compact table behind the daily reports: run counts per day, kind of run and milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.config import Config
from cutpoint.operators.scope import DID_WORK, FROM_RESULT_CACHE, SUCCEEDED
from cutpoint.session import group_by

EXEC = "exec"
QUEUE = "queue"
FLAGS = ["is_pattern", "is_live", "is_cached", "is_success"]

# Successful run of a matched pattern that did work: the scope of the performance reports.
IS_COMPARABLE = "(is_pattern AND is_live AND is_success)"
QUEUE_MS = (
    "coalesce(queued_overload_time, 0) + coalesce(queued_provisioning_time, 0)"
    " + coalesce(queued_repair_time, 0)"
)


def workload_counts(marked_rows: DataFrame, cfg: Config) -> DataFrame:
    """Rows (keys, activity_date, warehouse_name, is_pattern, is_live, is_cached, is_success, n).

    Enough for every report that counts runs and reads no times: days × warehouses × kinds of run.
    """
    by = dict.fromkeys([*cfg.keys, "activity_date", "warehouse_name"])
    return group_by(marked_rows.selectExpr(*by, *_kinds()), [*by, *FLAGS], ["count(1) AS n"])


def _kinds() -> list[str]:
    return [
        "is_pattern",
        f"{DID_WORK} AS is_live",
        f"{FROM_RESULT_CACHE} AS is_cached",
        f"{SUCCEEDED} AS is_success",
    ]


def workload_cells(marked_rows: DataFrame, cfg: Config, *, with_queue: bool) -> DataFrame:
    """Rows (keys, activity_date, measure, is_pattern, is_live, is_cached, is_success, ms, n).

    Measure ``exec`` holds every run once, with its execution milliseconds when it did work.
    Measure ``queue`` (on request) holds every run once with its queued milliseconds. Both come
    from one scan. The table grows with days × distinct milliseconds, not with runs, and one
    aggregate, combined on the map side, makes it.
    """
    day = [*cfg.keys, "activity_date"]
    kinds = marked_rows.selectExpr(
        *day,
        *_kinds(),
        f"CAST(CASE WHEN {DID_WORK} THEN execution_time END AS BIGINT) AS ms",
        *([f"CAST({QUEUE_MS} AS BIGINT) AS queue_ms"] if with_queue else []),
    )
    if with_queue:
        run = f"struct('{EXEC}' AS measure, {', '.join(FLAGS)}, ms)"
        wait = f"struct('{QUEUE}' AS measure, {', '.join(f'false AS {f}' for f in FLAGS)}, queue_ms AS ms)"
        kinds = kinds.selectExpr(*day, f"inline(array({run}, {wait}))")
    else:
        kinds = kinds.selectExpr(*day, f"'{EXEC}' AS measure", *FLAGS, "ms")
    return group_by(kinds, [*day, "measure", *FLAGS, "ms"], ["count(1) AS n"])
