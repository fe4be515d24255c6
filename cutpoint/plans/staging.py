"""Staging: both fact tables as Parquet partitioned by UTC day, full and incremental."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

from cutpoint.config import Config, utc_today
from cutpoint.functions.dates import day, from_instant, midnight, time_dimensions, utc_time, utc_wall_clock
from cutpoint.operators.scope import in_scope, period_label
from cutpoint.sources.schema import (
    METERING,
    METERING_SOURCE,
    QUERY_HISTORY,
    QUERY_HISTORY_SOURCE,
    conform,
    read_staged,
)
from cutpoint.session import group_by
from cutpoint.sources.folders import DAY, remove, staged_days
from cutpoint.sources.snapshots import Manifest, Snapshots

EPOCH = datetime(1970, 1, 1)


def _stage(
    source: DataFrame,
    schema,
    cfg: Config,
    as_of: datetime | date | None,
    since: datetime | None,
    *,
    inclusive: bool,
) -> DataFrame:
    """Source rows in scope, of complete UTC days, with UTC times and calendar columns.

    From the start of the first week when ``since`` is None, else from that UTC time on. The time
    limits are literals on the raw column, so a source sorted or partitioned by it skips data.
    """
    source = conform(source, schema)
    start = utc_wall_clock(source, "start_time")
    first = cfg.staging_start if since is None else since.date()
    conditions = [
        in_scope(cfg),
        "warehouse_name IS NOT NULL",
        f"start_time >= {midnight(source, 'start_time', first)}",
        f"start_time < {midnight(source, 'start_time', utc_today(as_of))}",
    ]
    if since is not None:
        conditions.append(f"{start} {'>=' if inclusive else '>'} {utc_time(since)}")
    times = {c: utc_wall_clock(source, c) for c in ("start_time", "end_time")}
    return source.where(" AND ".join(conditions)).selectExpr(
        *[f"{times.get(c, c)} AS {c}" for c in source.columns],
        *[f"{expression} AS {name}" for name, expression in time_dimensions(start).items()],
        f"{from_instant('current_timestamp()')} AS last_inserted_at",
    )


def stage_query_rows(source: DataFrame, cfg: Config, as_of=None, since=None) -> DataFrame:
    """Query history: rows that start after ``since``."""
    return _stage(source, QUERY_HISTORY_SOURCE, cfg, as_of, since, inclusive=False)


def stage_metering_rows(source: DataFrame, cfg: Config, as_of=None, since=None) -> DataFrame:
    """Metering: rows that start at ``since`` or later."""
    return _stage(source, METERING_SOURCE, cfg, as_of, since, inclusive=True)


def _write(rows: DataFrame, path: str, sort_by: list[str], mode: str, overwrite: str = "static") -> None:
    """Write by day, sorted for row-group skipping.

    Rebalancing brings a day's rows together and lets adaptive execution split a large day over
    many tasks and files, so no day has to fit one task. The columns of ``sort_by`` get Bloom filters, no larger than
    their row group needs: order alone tells little where a day has many files.
    """
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in sort_by} | {"parquet.bloom.filter.adaptive.enabled": "true"}
    (
        rows.hint("rebalance", "activity_date")
        .sortWithinPartitions("activity_date", *sort_by)
        .write.mode(mode)
        .option("partitionOverwriteMode", overwrite)
        .options(**blooms)
        .partitionBy("activity_date")
        .parquet(path)
    )


def refresh_query_history(source: DataFrame, path: str, cfg: Config, as_of=None) -> None:
    """Replace the staged query history."""
    _write(stage_query_rows(source, cfg, as_of), path, ["query_parameterized_hash"], "overwrite")


def refresh_metering(source: DataFrame, path: str, cfg: Config, as_of=None) -> None:
    """Replace the staged metering."""
    _write(stage_metering_rows(source, cfg, as_of), path, [], "overwrite")


def high_water_mark(staged: DataFrame, as_of: datetime | date | None = None) -> datetime:
    """Latest staged start time, the epoch for an empty table. One value reaches the driver.

    Days are searched backwards from ``as_of``, in steps that grow, with a filter on the partition column:
    a daily load opens the files of the last days only, however many the table has.
    """
    upper, days = None, 4
    while True:
        lower = utc_today(as_of) - timedelta(days=days)
        limits = [f"activity_date < {day(upper)}"] if upper else []
        limits += [f"activity_date >= {day(lower)}"] if lower.year > 1970 else []
        latest = staged.where(" AND ".join(limits) or "TRUE")
        mark = group_by(latest, [], ["max(start_time)"]).first()[0]
        if mark is not None or lower.year <= 1970:
            return mark or EPOCH
        upper, days = lower, days * 8


def latest_mark(spark: SparkSession, path: str, schema=QUERY_HISTORY) -> datetime:
    """High-water mark of a table by its path: the listing names the latest day, and only its files are opened."""
    for latest in reversed(staged_days(spark, path)):
        rows = read_staged(spark, path, schema).where(f"activity_date = {day(latest)}")
        mark = group_by(rows, [], ["max(start_time)"]).first()[0]
        if mark is not None:
            return mark
    return EPOCH


def _staged(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return read_staged(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_query_history(
    source: DataFrame, path: str, cfg: Config, as_of=None, *, overlap_days: int = 0
) -> None:
    """Append rows that start after the latest staged one.

    Query rows are final once written, so nothing is revisited. ``overlap_days`` looks back that
    many days from the mark for rows that arrived late and adds those whose ``query_id`` is not
    staged yet. An empty table is loaded from the start of the first week.
    """
    staged = _staged(source.sparkSession, path, QUERY_HISTORY)
    mark = latest_mark(source.sparkSession, path)
    if mark == EPOCH:
        rows = stage_query_rows(source, cfg, as_of)
    elif overlap_days:
        since = mark - timedelta(days=overlap_days)
        known = staged.where(f"activity_date >= {day(since.date())}").select("query_id")
        rows = stage_query_rows(source, cfg, as_of, since).join(known, "query_id", "left_anti")
        rows = rows.select(*[f.name for f in QUERY_HISTORY.fields])
    else:
        rows = stage_query_rows(source, cfg, as_of, mark)
    _write(rows, path, ["query_parameterized_hash"], "append")


def reload_metering(source: DataFrame, path: str, cfg: Config, as_of=None) -> None:
    """Replace staged metering from the latest staged interval on, which the source may revise.

    Only the days from the mark's day on are rewritten, in one write: the kept earlier intervals of
    that day together with the new rows. Where neither are left, the source has withdrawn the day: its
    folder is removed, before the later days are written. A rerun gives the same table, also after a
    failure in between: the mark is then an earlier one.
    """
    spark = source.sparkSession
    staged = _staged(spark, path, METERING)
    mark = latest_mark(spark, path, METERING)
    if mark == EPOCH:
        _write(stage_metering_rows(source, cfg, as_of), path, [], "append")
        return
    kept = staged.where(
        f"activity_date = {day(mark.date())} AND start_time < {utc_time(mark)}"
    )
    rows = kept.unionByName(stage_metering_rows(source, cfg, as_of, mark))
    if rows.where(f"activity_date = {day(mark.date())}").isEmpty():
        remove(spark, f"{path}/{DAY}{mark.date().isoformat()}")
        rows = stage_metering_rows(source, cfg, as_of, mark)
    _write(rows, path, [], "overwrite", "dynamic")


def replace_metering(source: DataFrame, path: str, cfg: Config, as_of=None) -> Manifest:
    """As ``reload_metering``, for a table of snapshots: the revised tail replaces the old one in one step.

    Readers see the table before or after the load, never a day withdrawn with the later days still old. A load
    that fails leaves the table as it was; of two at the same time one is refused (``Conflict``).
    """
    spark = source.sparkSession
    table = Snapshots(spark, path)
    before = table.current()
    mark = None
    for latest in sorted(before.days, reverse=True):
        mark = group_by(table.read(METERING, before, [latest]), [], ["max(start_time)"]).first()[0]
        if mark is not None:
            break
    rows = stage_metering_rows(source, cfg, as_of, mark)
    if mark is not None:
        rows = table.read(METERING, before, [mark.date()]).where(f"start_time < {utc_time(mark)}").unionByName(rows)
    written = table.write(rows)
    kept = {d: load for d, load in before.days.items() if mark is not None and d < mark.date()}
    return table.commit(before, kept | written)


def coverage(query_history: DataFrame, metering: DataFrame, cfg: Config) -> DataFrame:
    """Days and latest day per staged table and period. Reads the partition column only."""

    def of(table: DataFrame, source: str) -> DataFrame:
        days = table.selectExpr("activity_date", f"{period_label(cfg)} AS period_type")
        aggregates = ["count(DISTINCT activity_date) AS days_covered", "max(activity_date) AS last_date"]
        return group_by(days, ["period_type"], aggregates).selectExpr(f"'{source}' AS source", "*")

    return of(query_history, "qh").unionByName(of(metering, "wh")).orderBy("source", "period_type")


def coverage_of(spark: SparkSession, query_history: str, metering: str, cfg: Config) -> DataFrame:
    """The same for staged tables by their paths, from their listings: no data file is opened, none is scanned."""

    def days(path: str) -> DataFrame:
        return spark.createDataFrame([(d,) for d in staged_days(spark, path)], "activity_date date")

    return coverage(days(query_history), days(metering), cfg)
