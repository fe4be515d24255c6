"""Row scope as SQL conditions: warehouse filter, date window, period label."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutpoint.config import GEN1, GEN2, Config
from cutpoint.functions.dates import day
from cutpoint.functions.numeric import text

PATTERN = "query_parameterized_hash"

# NULL status is neither a success nor an error; NULL bytes are neither work nor a cache hit.
SUCCEEDED = "coalesce(execution_status = 'SUCCESS', false)"
FAILED = "execution_status != 'SUCCESS'"
DID_WORK = "coalesce(bytes_scanned > 0, false)"
FROM_RESULT_CACHE = "coalesce(bytes_scanned = 0, false)"


def in_scope(cfg: Config) -> str:
    if cfg.covers_everything:
        return "warehouse_name IS NOT NULL"
    return f"warehouse_name LIKE {text(cfg.scope_like)}"


def in_window(cfg: Config) -> str:
    """On the partition column itself, so that days outside are never read."""
    return f"activity_date BETWEEN {day(cfg.first_day)} AND {day(cfg.last_day)}"


def is_after(cfg: Config) -> str:
    return f"activity_date >= {day(cfg.cutover)}"


def period_label(cfg: Config) -> str:
    return f"CASE WHEN {is_after(cfg)} THEN '{GEN2}' ELSE '{GEN1}' END"


def only_days(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the days in ``wanted``, as a literal list on the partition column.

    The list reaches the driver; it has at most as many entries as the window has days. Literals
    prune the scan however large ``wanted`` is, which a join does only when it is broadcast.
    """
    days = sorted(r[0] for r in wanted.select("activity_date").distinct().collect())
    return rows.where(f"activity_date IN ({', '.join(map(day, days))})" if days else "false")
