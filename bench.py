"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Median of 3 runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import time

from foldspark.plans.catalogue import QUERIES
from foldspark.session import spark_session

HEADLINE = ("supervised_matrix", "fold_metrics_report", "pooled_metrics_report", "block_bootstrap", "panel_segment_backtest", "promotion_decision", "ridge_backtest", "boosting_backtest")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(f"local[{cpus}]", 8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
