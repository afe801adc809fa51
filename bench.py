"""Times the queries: one JSON line on stdout.

The stored tables (``build_tables``) are written once and timed on their own; each
query is then run once into a sink that drops its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from ledgerloom.queries import REGISTRY
    from ledgerloom.workspace import workspace

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    start = time.perf_counter()
    space = workspace(spark, sf_dir)
    for table in ("records", "outcomes", "expenses", "batches", "processes"):
        getattr(space, table)
    times["build_tables"] = round(time.perf_counter() - start, 3)
    for name, query in REGISTRY.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        try:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
        print(name, times.get(name, failed.get(name)), file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
