"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then timed to a full evaluation of all
its columns without storing them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from loadweave.catalog import REGISTRY

HEADLINE = (
    "hourly_dataset",
    "load_first_across_files",
    "national_mean",
    "weighted_national_mean",
    "continuity_per_city",
    "lags_national",
    "rolling_mean_national",
    "rolling_std_per_city",
    "feature_table",
    "nearest_lookup",
    "utc_from_local",
    "wide_to_long_utc",
    "report_to_long_utc",
    "report_text_scan",
    "load_payload_table",
    "weather_payload_expand",
    "daily_backtest_metrics",
    "residual_load",
    "extreme_demand",
    "gap_fill",
    "holiday_flag",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loadweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run = REGISTRY[name].run
        run(spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
