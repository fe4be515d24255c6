"""The same workload under changes that didn't happen: what would the reports have said?"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame

from cutpoint.functions.numeric import text
from cutpoint.operators.scope import is_after
from cutpoint.plans.workload import Workload

SCENARIO = "scenario"


@dataclass(frozen=True)
class Effect:
    """What a change does to the runs and credits from the cutover on, in whole per cent.

    ``failing``, ``slow`` and ``waiting`` are shares of the runs, drawn by a digest of the query id, so the same
    runs are drawn everywhere and again; runs without an id are never drawn.
    """

    times: int = 100  #: of the execution time
    credits: int = 100  #: of the credits
    failing: int = 0  #: runs that fail
    slow: int = 0  #: runs that take ``slow_times`` of their execution time instead of ``times``
    slow_times: int = 400
    waiting: int = 0  #: runs that wait ``wait_ms`` longer
    wait_ms: int = 5000
    days: int = 100_000  #: days after the cutover that there is data of


DRAWN = "CAST(conv(substr(md5(query_id), 1, 6), 16, 10) AS INT) % 100"


def with_effects(w: Workload, effects: Mapping[str, Effect]) -> Workload:
    """The workload once per effect, keyed by ``scenario``: each report then says in one job what it says of all.

    Facts are multiplied by the number of effects while they are counted; nothing of that size is written.
    """
    cfg = w.cfg
    kinds = ", ".join(
        "struct(" + ", ".join([f"{text(name)} AS {SCENARIO}", *(f"{v} AS effect_{k}" for k, v in asdict(e).items())]) + ")"
        for name, e in effects.items()
    )
    later = f"({is_after(cfg)})"

    def changed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        each = rows.selectExpr("*", f"inline(array({kinds}))")
        there = each.where(f"datediff(activity_date, DATE'{cfg.cutover.isoformat()}') < effect_days")
        return there.selectExpr(*[f"{columns.get(c, c)} AS {c}" for c in rows.columns], SCENARIO)

    runs = changed(
        w.query_history,
        {
            "execution_time": f"""CASE WHEN {later} THEN execution_time
                * CASE WHEN {DRAWN} < effect_slow THEN effect_slow_times ELSE effect_times END DIV 100
                ELSE execution_time END""",
            "execution_status": f"""CASE WHEN {later} AND execution_status = 'SUCCESS' AND {DRAWN} >= 100 - effect_failing
                THEN 'FAIL' ELSE execution_status END""",
            "queued_overload_time": f"""CASE WHEN {later} AND {DRAWN} < effect_waiting
                THEN coalesce(queued_overload_time, 0) + effect_wait_ms ELSE queued_overload_time END""",
        },
    )
    meters = changed(
        w.metering,
        {
            "credits_used": f"""CAST(CASE WHEN {later} THEN CAST(credits_used AS DECIMAL(24,9))
                * CAST(effect_credits AS DECIMAL(6,0)) * 0.01BD ELSE credits_used END AS DECIMAL(38,9))"""
        },
    )
    return Workload(runs, meters, replace(cfg, keys=(*cfg.keys, SCENARIO)), share=w.share)
