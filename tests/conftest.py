from __future__ import annotations

import datetime as dt
import itertools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cutpoint import Config, Workload  # noqa: E402
from cutpoint.plans.staging import stage_metering_rows, stage_query_rows  # noqa: E402
from cutpoint.sources.schema import METERING_SOURCE, QUERY_HISTORY_SOURCE  # noqa: E402

CUTOVER = dt.date(2024, 3, 11)


@pytest.fixture(scope="session")
def compiled_spark():
    """A session as in production."""
    from bench import session

    return session(4)


@pytest.fixture(scope="session")
def spark(compiled_spark):
    """The same application without code generation: for a few rows, compiling takes the most time."""
    spark = compiled_spark.newSession()
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return spark


class Facts:
    """Small hand-made facts. Days are numbered from the cutover: −1 is the last day before it."""

    def __init__(self, spark):
        self.spark = spark
        self.runs: list[dict] = []
        self.meters: list[dict] = []
        self.ids = itertools.count()

    def run(self, day: int, ms=1000, pattern="p", *, status="SUCCESS", bytes=1, warehouse="ANALYTICS_A", **more):
        start = dt.datetime.combine(CUTOVER + dt.timedelta(days=day), dt.time(8))
        self.runs.append(
            {
                "query_id": str(next(self.ids)),
                "query_text": f"text {pattern}",
                "query_parameterized_hash": pattern,
                "start_time": start,
                "end_time": start,
                "execution_time": ms,
                "warehouse_name": warehouse,
                "execution_status": status,
                "bytes_scanned": bytes,
                **more,
            }
        )

    def meter(self, day: int, credits: str, *, warehouse="ANALYTICS_A", hour=8):
        start = dt.datetime.combine(CUTOVER + dt.timedelta(days=day), dt.time(hour))
        self.meters.append(
            {"start_time": start, "end_time": start, "warehouse_name": warehouse, "credits_used": credits}
        )

    def sources(self):
        import decimal

        def frame(rows, schema):
            values = [
                tuple(
                    decimal.Decimal(r[f.name]) if f.name == "credits_used" else r.get(f.name) for f in schema
                )
                for r in rows
            ]
            return self.spark.createDataFrame(values, schema)

        return frame(self.runs, QUERY_HISTORY_SOURCE), frame(self.meters, METERING_SOURCE)

    def workload(self, *, share=False, **config) -> Workload:
        cfg = Config(cutover=CUTOVER, **{"lookback_days": 30, "lookahead_days": 29, **config})
        runs, meters = self.sources()
        return Workload(stage_query_rows(runs, cfg), stage_metering_rows(meters, cfg), cfg, share=share)


@pytest.fixture
def facts(spark):
    return Facts(spark)


@pytest.fixture
def steady(facts):
    """35 days before, 30 after: 20 runs of 4 patterns a day, times 2 s ± a daily swing, 10 credits a day."""
    for day in range(-35, 30):
        for i in range(20):
            swing = (day * 7 + i * 13) % 11
            facts.run(day, 1800 + 40 * swing + 10 * i, f"p{i % 4}", status="FAIL" if i == 19 and day % 3 == 0 else "SUCCESS")
        facts.meter(day, str(10 + (day * 5) % 7 / 10))
    return facts


@pytest.fixture
def evaluate(spark):
    """Values of SQL expressions over rows given as dicts (None is a double NULL)."""

    def run(rows: list[dict], *expressions: str):
        def literal(v):
            if v is None:
                return "CAST(NULL AS DOUBLE)"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, str):
                return "'" + v.replace("'", "\\'") + "'"
            if isinstance(v, int):
                return f"{v}L"
            return f"{float(v)!r}D"

        names = list(rows[0])
        values = ", ".join(
            f"({i}, " + ", ".join(literal(row[n]) for n in names) + ")" for i, row in enumerate(rows)
        )
        df = spark.sql(f"SELECT * FROM VALUES {values} AS t(row_no, {', '.join(names)})")
        found = df.selectExpr("row_no", *[f"{e} AS e{i}" for i, e in enumerate(expressions)]).collect()
        return [tuple(r)[1:] for r in sorted(found)]

    return run
