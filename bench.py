"""Time every query: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.folders import name_folder

HEADLINE = [
    "stage_query_history",
    "incremental_append",
    "metering_reload",
    "data_validation_orders",
    "perf_daily_orders",
    "perf_welch_test_orders",
    "perf_by_dow_orders",
    "perf_summary_orders",
    "cost_daily_orders",
    "cost_welch_test_orders",
    "cost_by_dow_orders",
    "reliability_orders",
    "error_analysis_orders",
    "pattern_regressions_orders",
    "top_regressions_orders",
    "daily_trend_orders",
    "migration_decision_orders",
    "migration_decision",
]


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cutpoint")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    name_folder(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from checks.catalog import PER_WORKLOAD, all_queries, orders_workload
    from cutpoint.plans.reports import REPORTS

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    queries = all_queries()
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        started = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - started, 3)

    queries["perf_daily"](spark, folder).collect()  # start the JVM, not timed
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, folder).collect())

    def suite() -> None:
        w = orders_workload(spark, folder, share=True)
        for report in REPORTS.values():
            report(w).collect()

    timed("all_reports_shared_orders", suite)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    assert set(REPORTS) <= set(PER_WORKLOAD)


if __name__ == "__main__":
    main()
