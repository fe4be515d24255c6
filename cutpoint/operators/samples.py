"""Sample texts of groups: rows of few groups alone, and the first run of each, found without reading texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutpoint.config import Config
from cutpoint.functions.numeric import text
from cutpoint.operators.scope import only_days
from cutpoint.session import group_by, join_by, settle

SAMPLE_LENGTH = 200
SAMPLE_TEXT = f"left(query_text, {SAMPLE_LENGTH})"
#: Where a row of a file scan lies.
PLACE = {"file_path": "_metadata.file_path", "row_index": "_metadata.row_index"}
PLACE_COLUMNS = [f"{of} AS {name}" for name, of in PLACE.items()]
# What a row of a broadcast takes besides its path.
ROW_BYTES = 64


def only_values(rows: DataFrame, column: str, wanted: DataFrame, name: str, limit: int) -> DataFrame:
    """Rows whose ``column`` is among the values ``name`` of ``wanted``, where these are at most ``limit``; else all rows.

    Equalities with literals reach the Parquet scan, where statistics, dictionaries, Bloom filters and page indexes
    decide what is read. A list of over ten values would only reach it as a range. At most ``limit`` + 1 values
    reach the driver. A NULL is no value to look for: it can't be told from a filter, so all rows are kept.
    """
    values = [r[0] for r in wanted.select(name).distinct().limit(limit + 1).collect()]
    if len(values) > limit or None in values:
        return rows
    return rows.where(" OR ".join(f"{column} = {text(v)}" for v in sorted(values)) or "false")


def first_samples(rows: DataFrame, wanted: DataFrame, cfg: Config, column: str, name: str) -> DataFrame:
    """Text and warehouse of the first run of each group (by start, then query id) on its day.

    ``wanted`` has the keys, the group ``name`` (``column`` of the rows) and the day (activity_date). The run is chosen on
    narrow columns, with its place: file and position. The text column is then read in a second pass, of the
    files with a chosen run alone, and only those texts go on. Both passes look for few groups by value. Where the
    places fit a broadcast, no text is shuffled; else texts, cut to their samples, meet them by a shuffle.

    Runs of equal start and query id (or NULL ids) are told apart by their place, so the sample is the same in
    every run over the same files. Files replaced between the passes leave a sample NULL.
    """
    limits = cfg.tuning
    by = [*cfg.keys, name]
    on = [*by, "activity_date"]
    near = only_values(only_days(rows, wanted), column, wanted, name, limits.lookup_values)
    try:
        placed = near.selectExpr("*", *PLACE_COLUMNS)
    except AnalysisException as e:
        raise ValueError("samples of first runs need a query history that is read from files") from e
    runs = placed.selectExpr(
        *cfg.keys,
        f"{column} AS {name}",
        "activity_date",
        "struct(start_time, query_id, file_path, row_index, warehouse_name) AS run",
    )
    first = join_by(group_by(runs, on, ["min(run) AS run"]), wanted, cfg.keys, on)
    chosen = settle(
        first.selectExpr(*by, "run.file_path AS file_path", "run.row_index AS row_index", "run.warehouse_name AS sample_warehouse")
    )
    texts = near.selectExpr(*PLACE_COLUMNS, f"{SAMPLE_TEXT} AS sample_query")
    files = [r[0] for r in chosen.select("file_path").distinct().limit(limits.lookup_files + 1).collect()]
    if len(files) <= limits.lookup_files:
        texts = texts.where(F.col("file_path").isin(sorted(files)))
    places = chosen.select(*PLACE)
    n, size = group_by(places, [], ["count(*)", f"coalesce(sum(octet_length(file_path) + {ROW_BYTES}), 0)"]).first()
    small = n <= limits.broadcast_max_rows and size <= limits.broadcast_max_bytes
    found = join_by(texts, places, [], [*PLACE], hint="broadcast" if small else "")
    return join_by(chosen, found, [], [*PLACE], "left").select(*by, "sample_query", "sample_warehouse")
