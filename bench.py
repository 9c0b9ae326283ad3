"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
tables and the cores. Each query runs once to warm up, then BENCH_RUNS times
(default 3); its median, with building the plan included, is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from kerbflow.plans.catalog import QUERIES
from kerbflow.session import local_session

HEADLINE = (
    "heatmap", "rollup_daily_company", "rollup_daily_zone", "rollup_hourly", "rollup_measures",
    "rollup_grouping_sets", "unified_daily_company", "unified_daily_area", "unified_daily_zone",
    "annual_summary", "kpis", "growth_stats", "resample_month", "series_spine",
    "compare_month_prev", "growth_gains", "enriched_rollup", "temp_trendline", "event_calendar",
    "event_impact", "event_summary", "forecast_naive", "forecast_holt_winters", "forecast_ridge",
    "hex_density", "point_sample", "zone_centroids", "link_discovery", "competitor_rank",
    "stream_hourly", "stored_rollups", "manifest", "rollup_five_grains", "forecast_selected",
    "event_did",
)


def run(spark, folder: str, name: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "kerbflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries (warm, median)",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
