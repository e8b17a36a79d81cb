"""Times the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up, then $BENCH_RUNS times; the median counts. The retail
tables are derived from the given ones before that, timed as ``stage_tables``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from functools import cached_property

from pyspark.sql import SparkSession

from tillbook.plans.registry import all_queries
from tillbook.plans.staging import RetailData, retail_data
from tillbook.plans.worktables import drop_work_tables

SOURCE = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# The folder that executors share; on one machine any folder is.
WORK = os.environ.get("BENCH_WORK_DIR") or tempfile.mkdtemp(prefix="bench-")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tillbook-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", WORK)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(query):
        query(spark, SOURCE).write.format("noop").mode("overwrite").save()

    def stage(data):
        for name, member in vars(RetailData).items():
            if isinstance(member, cached_property):
                getattr(data, name)

    stage(RetailData(spark, SOURCE))
    seconds = {"stage_tables": round(timed(lambda: stage(retail_data(spark, SOURCE))), 3)}
    only = sys.argv[1:]
    for name, query in all_queries().items():
        if only and name not in only:
            continue
        run(query)
        seconds[name] = round(
            statistics.median(timed(lambda: run(query)) for _ in range(RUNS)), 3
        )
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SOURCE.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    drop_work_tables(spark)
    spark.stop()


if __name__ == "__main__":
    main()
