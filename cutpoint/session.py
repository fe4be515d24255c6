"""Where intermediate results may be written."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutpoint.sources.folders import remove


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate tables: the session's checkpoint folder (``spark.checkpoint.dir``)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Settled:
    """The tables that were settled under one owner; they go when it is closed and nobody else holds them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.readers = 1

    def hold(self) -> Settled:
        """One more reader: the tables stay until each has closed."""
        if not self.readers:
            raise ValueError("the tables have been removed")
        self.readers += 1
        return self

    def close(self) -> None:
        """One reader less; with the last, the folders are removed. Closing again has no effect."""
        self.readers = max(0, self.readers - 1)
        while not self.readers and self.paths:
            remove(self.spark, self.paths.pop())


_owner: ContextVar[Settled | None] = ContextVar("owner of settled tables", default=None)


@contextmanager
def settling(spark: SparkSession) -> Iterator[Settled]:
    """Tables settled inside belong to the owner given and are removed at the end, unless a reader still holds it.

    >>> with settling(spark) as tables:
    ...     migration_decision(w).show()
    """
    owner = Settled(spark)
    token = _owner.set(owner)
    try:
        yield owner
    finally:
        _owner.reset(token)
        owner.close()


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once for several readers, in a form that outlives lost executors.

    Written as a table to the shared folder, so that later scans prune columns and the planner
    knows the size. A session that names no such folder is refused. Inside ``settling`` the table has an
    owner, also if writing it fails; else it stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "settled")
    if owner := _owner.get():
        owner.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def query(statement: str, **tables: DataFrame) -> DataFrame:
    """Spark SQL over DataFrames, named in braces in the statement."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(statement, **tables)


def listed(*columns: str) -> str:
    """A SQL column list."""
    return ", ".join(columns)


def group_by(df: DataFrame, by: list[str], aggregates: list[str]) -> DataFrame:
    """GROUP BY with aggregates given as SQL; one row without ``by``, even for no input."""
    clause = f" GROUP BY {listed(*by)}" if by else ""
    return query(f"SELECT {listed(*by, *aggregates)} FROM {{df}}{clause}", df=df)


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], on: list[str], how: str = "inner", hint: str = "") -> DataFrame:
    """Join on columns of both sides, null-safe on those among ``keys``; the columns of ``right`` named in ``on`` go."""
    other = {c: f"{c}\0right" for c in on}
    right = right.select(*[F.col(c).alias(other.get(c, c)) for c in right.columns])
    at = [F.col(c).eqNullSafe(F.col(o)) if c in keys else F.col(c) == F.col(o) for c, o in other.items()]
    return left.join(right.hint(hint) if hint else right, at, how).drop(*other.values())


def full_join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], on: list[str]) -> DataFrame:
    """Full join on columns of both sides, null-safe on those among ``keys``; one column each is left of them."""
    other = {c: f"{c}\0right" for c in on}
    right = right.select(*[F.col(c).alias(other.get(c, c)) for c in right.columns])
    at = [F.col(c).eqNullSafe(F.col(o)) if c in keys else F.col(c) == F.col(o) for c, o in other.items()]
    met = left.join(right, at, "full")
    rest = [c for c in (*left.columns, *right.columns) if c not in on and c not in other.values()]
    return met.select(*[F.coalesce(F.col(c), F.col(o)).alias(c) for c, o in other.items()], *rest)
