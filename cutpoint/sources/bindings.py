"""Fact tables out of the driver tables (FIXTURES.md, bindings A and B)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from cutpoint.config import Config
from cutpoint.sources.schema import METERING_SOURCE, QUERY_HISTORY_SOURCE, conform

# Binding A: one month of events with times within the day.
EVENTS_CONFIG = Config(cutover=date(2024, 1, 16), lookback_days=15, lookahead_days=14)
# Binding B: two years of order lines, dates only.
ORDERS_CONFIG = Config(cutover=date(1998, 6, 1), lookback_days=365, lookahead_days=364)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").selectExpr("*", "get_json_object(props, '$.k') AS k")
    return conform(
        rows.selectExpr(
            "CAST(event_id AS STRING) AS query_id",
            "concat(event_type, ' ', k) AS query_text",
            "k AS query_parameterized_hash",
            "ts AS start_time",
            "ts AS end_time",
            "CAST(round(value * 1000) AS BIGINT) AS execution_time",
            "concat('ANALYTICS_', user_id % 4) AS warehouse_name",
            "CASE WHEN event_type != 'error' THEN 'SUCCESS'"
            " WHEN CAST(k AS INT) < 10 THEN 'INCIDENT' ELSE 'FAIL' END AS execution_status",
            "CASE WHEN event_type = 'view' THEN 0 ELSE event_id + 1 END AS bytes_scanned",
            "CAST(k AS BIGINT) * 10 AS queued_overload_time",
            "CASE WHEN event_type != 'click' THEN 0 END AS queued_provisioning_time",
            "0 AS queued_repair_time",
        ),
        QUERY_HISTORY_SOURCE,
    )


def events_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return conform(
        rows.selectExpr(
            "ts AS start_time",
            "ts AS end_time",
            "concat('ANALYTICS_', user_id % 4) AS warehouse_name",
            "CAST(value AS DECIMAL(38,9)) AS credits_used",
        ),
        METERING_SOURCE,
    )


def orders_query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _table(spark, sf_dir, "lineitem").selectExpr(
            "concat(l_orderkey, '-', l_linenumber) AS query_id",
            "concat('part ', l_partkey) AS query_text",
            "CAST(l_suppkey AS STRING) AS query_parameterized_hash",
            "l_shipdate AS start_time",
            "l_shipdate AS end_time",
            "CAST(round(l_extendedprice) AS BIGINT) AS execution_time",
            "concat('ANALYTICS_', l_orderkey % 4) AS warehouse_name",
            "CASE WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status",
            "CASE WHEN l_quantity <= 5 THEN 0 ELSE CAST(round(l_quantity) AS BIGINT) END AS bytes_scanned",
        ),
        QUERY_HISTORY_SOURCE,
    )


def orders_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _table(spark, sf_dir, "orders").selectExpr(
            "o_orderdate AS start_time",
            "o_orderdate AS end_time",
            "concat('ANALYTICS_', o_orderkey % 4) AS warehouse_name",
            "round(CAST(o_totalprice / 1000 AS DECIMAL(38,10)), 2) AS credits_used",
        ),
        METERING_SOURCE,
    )
