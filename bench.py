"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` is the tables' folder, ``BENCH_CPUS`` the number of local threads. Every query is
run in full into a sink that discards its rows; jobs that run while it is built count as well.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.plans.catalog import QUERIES  # noqa: E402
from panelweave.sources import release  # noqa: E402

HEADLINES = [
    "missing_audit",
    "blank_to_null_cast",
    "fill_prev_category",
    "fill_first_value",
    "fill_adjacent",
    "fill_mean_cascade",
    "dedupe_keyed",
    "low_outliers_lines",
    "out_of_range",
    "describe_by_entity",
    "describe_lines",
    "trend_slope",
    "latest_group_mean",
    "pearson_global",
    "pareto_tiers_latest",
    "mean_by_tier",
    "mean_by_two_tiers",
    "rows_at_extremes",
    "extreme_profile",
    "rolling_mean_orders",
    "mean_by_region",
    "running_amount",
    "health_clean",
    "health_life_expectancy_by_disease",
    "health_gdp_correlations_by_tier",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
