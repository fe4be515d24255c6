"""Reports after a daily load that read the new days' facts, not the window's.

Kept by day: runs per pattern (counts that add up over any window) and cells, marked with the patterns matched at the
time. A day's counts depend on its facts alone. Its cells also depend on which patterns are matched; when that set
changes, the counts tell on which days a changed pattern ran, and only their cells are made anew.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cutpoint.config import Config
from cutpoint.functions.dates import day
from cutpoint.operators.cells import workload_cells
from cutpoint.operators.patterns import IN_BOTH
from cutpoint.operators.scope import PATTERN, in_scope, in_window, is_after
from cutpoint.plans.workload import Workload
from cutpoint.session import group_by, join_by, listed, settle
from cutpoint.sources.folders import day_signatures
from cutpoint.sources.schema import QUERY_HISTORY, read_staged
from cutpoint.sources.snapshots import Manifest, Snapshots


@dataclass(frozen=True)
class Update:
    """Days whose facts were read: to count patterns, and to make cells."""

    counted: list[date]
    rebuilt: list[date]


class DailyState:
    """The state under ``path`` of the query history staged under ``facts``, for one scope and its keys.

    The cutover and the window may change between updates. A day that was written again (``overlap_days``, a full
    refresh) is found by its listing. Each update commits the counts, then the cells; one that dies in
    between or before is made up for by the next, since the cells name the counts that they were made with.
    """

    def __init__(self, spark: SparkSession, path: str, facts: str, cfg: Config):
        self.spark, self.facts, self.cfg = spark, facts, cfg
        self.counts = Snapshots(spark, f"{path.rstrip('/')}/patterns")
        self.cells = Snapshots(spark, f"{path.rstrip('/')}/cells")

    @property
    def _identity(self) -> dict[str, object]:
        return {"scope": self.cfg.scope_like, "keys": list(self.cfg.keys)}

    @property
    def _count_schema(self) -> T.StructType:
        fields = [QUERY_HISTORY[c] for c in dict.fromkeys([*self.cfg.keys, PATTERN, "activity_date"])]
        return T.StructType([*fields, T.StructField("runs", T.LongType())])

    def _cell_schema(self) -> T.StructType:
        w = Workload(self.spark.createDataFrame([], QUERY_HISTORY), None, self.cfg)
        rows = w.query_history.selectExpr("*", "true AS is_pattern")
        return workload_cells(rows, self.cfg, with_queue=True).schema

    def _facts(self, days: Iterable[date]) -> DataFrame:
        rows = read_staged(self.spark, self.facts, QUERY_HISTORY)
        return rows.where(f"activity_date IN ({listed(*map(day, sorted(days)))})")

    def _checked(self, held: Manifest) -> Manifest:
        if held.version and {k: held.notes[k] for k in self._identity} != self._identity:
            raise ValueError("the state was made for another scope or other keys")
        return held

    def _presence(self, counts: Manifest, cfg: Config) -> DataFrame:
        """Runs per pattern and period of a window, from the daily counts."""
        rows = self.counts.read(self._count_schema, counts).where(in_window(cfg))

        def runs(condition: str, name: str) -> str:
            return f"coalesce(sum(CASE WHEN {condition} THEN runs END), 0L) AS {name}"

        sums = [runs(f"NOT {is_after(cfg)}", "gen1_runs"), runs(is_after(cfg), "gen2_runs")]
        return group_by(rows, [*cfg.keys, PATTERN], sums)

    def _counted(self, days: dict[date, str]) -> tuple[Manifest, list[date]]:
        """Counts of all days of the window, and those that had to be counted."""
        before = self._checked(self.counts.current())
        known = dict(before.notes.get("days", {}))
        stale = [d for d in days if known.get(d.isoformat()) != days[d]]
        first, last = self.cfg.first_day.isoformat(), self.cfg.last_day.isoformat()
        gone = {d for d in known if first <= d <= last and date.fromisoformat(d) not in days}
        if not stale and not gone:
            return before, []
        kept = {d: load for d, load in before.days.items() if d not in stale and d.isoformat() not in gone}
        if stale:
            rows = self._facts(stale).where(f"{in_scope(self.cfg)} AND {PATTERN} IS NOT NULL")
            by = list(dict.fromkeys([*self.cfg.keys, PATTERN, "activity_date"]))
            kept |= self.counts.write(group_by(rows, by, ["count(1) AS runs"]), [PATTERN])
        signed = {d: s for d, s in known.items() if d not in gone} | {d.isoformat(): days[d] for d in stale}
        return self.counts.commit(before, kept, self._identity | {"days": signed}), stale

    def _marked_by(self, held: Manifest) -> DataFrame | None:
        """Patterns per period as they were for the cells of ``held``; None if that can't be told any more."""
        version = held.notes["patterns"]
        if version and version not in self.counts.versions():
            return None
        cutover = date.fromisoformat(held.notes["cutover"])
        then = replace(
            self.cfg,
            cutover=cutover,
            lookback_days=(cutover - date.fromisoformat(held.notes["first"])).days,
            lookahead_days=(date.fromisoformat(held.notes["last"]) - cutover).days,
        )
        return self._presence(self.counts.at(version), then)

    def _touched(self, counts: Manifest, now: DataFrame, before: DataFrame) -> set[date]:
        """Days with a run of a pattern that is matched now and wasn't before, or the reverse. At most the window's."""
        on = [*self.cfg.keys, PATTERN]
        both = now.where(IN_BOTH).selectExpr(*on, "1 AS sign").unionByName(before.where(IN_BOTH).selectExpr(*on, "-1 AS sign"))
        changed = group_by(both, on, ["sum(sign) AS sign"]).where("sign <> 0")
        rows = self.counts.read(self._count_schema, counts).where(in_window(self.cfg))
        found = join_by(rows, changed, self.cfg.keys, on, "left_semi").select("activity_date").distinct()
        return {r[0] for r in found.collect()}

    def update(self) -> Update:
        """Bring the state up to what is staged now."""
        cfg = self.cfg
        signed = day_signatures(self.spark, self.facts)
        days = {d: s for d, s in signed.items() if cfg.first_day <= d <= cfg.last_day}
        counts, counted = self._counted(days)
        held = self._checked(self.cells.current())
        notes = self._identity | {
            "days": {d.isoformat(): s for d, s in days.items()},
            "patterns": counts.version,
            "cutover": cfg.cutover.isoformat(),
            "first": cfg.first_day.isoformat(),
            "last": cfg.last_day.isoformat(),
        }
        if held.version and held.notes == notes:
            return Update(counted, [])
        presence = settle(self._presence(counts, cfg))
        before = self._marked_by(held) if held.version else None
        if before is None:
            rebuilt = set(days)
        else:
            known = held.notes["days"]
            rebuilt = {d for d in days if known.get(d.isoformat()) != days[d]}
            rebuilt |= self._touched(counts, presence, before) & set(days)
        kept = {d: load for d, load in held.days.items() if d in days and d not in rebuilt}
        if rebuilt:
            w = Workload(self._facts(rebuilt), None, cfg)
            w.presence = presence
            kept |= self.cells.write(workload_cells(w.marked_rows, cfg, with_queue=True), ["measure", "ms"])
        self.cells.commit(held, kept, notes)
        return Update(counted, sorted(rebuilt))

    def workload(self, metering: DataFrame) -> Workload:
        """The workload as of the last update. Its daily figures, and with them the decision, read the cells;
        volumes, single patterns and texts of errors are still looked up in the facts."""
        held = self._checked(self.cells.current())
        if not held.version or [held.notes[k] for k in ("cutover", "first", "last")] != [
            d.isoformat() for d in (self.cfg.cutover, self.cfg.first_day, self.cfg.last_day)
        ]:
            raise ValueError("update the state for this window first")
        w = Workload(read_staged(self.spark, self.facts, QUERY_HISTORY), metering, self.cfg, share=True)
        w.presence = settle(self._presence(self.counts.at(held.notes["patterns"]), self.cfg))
        w.cells_with_queue = self.cells.read(self._cell_schema(), held)
        return w
