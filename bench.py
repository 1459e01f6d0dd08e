"""Time the reports: one warm-up, then the median of three full runs each.

Prints one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; the
rows go to the ``noop`` sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from scorecraft.plans.registry import REPORTS, run
from scorecraft.session import build_session

HEADLINE = (
    "earned_value",
    "variance_trend",
    "risk_flags",
    "program_summary",
    "composite_scorecard",
    "quality_scores",
    "staffing_quartiles",
    "trajectory_segments",
    "delay_cascade",
    "disparity_gap",
    "primary_driver",
    "region_contrast",
)
RUNS = 3


def seconds(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    run(name, spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = REPORTS if os.environ.get("BENCH_ALL") else HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in wanted:
        seconds(spark, name, folder)
        timings[name] = round(
            statistics.median(seconds(spark, name, folder) for _ in range(RUNS)), 3
        )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_report_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
