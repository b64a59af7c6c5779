"""Time the headline queries; prints one JSON line.

Every query runs once cold and three times warm into the ``noop`` sink; the median warm time counts.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "crosswalk_join", "code_share_flag", "scenario_shares", "local_rate", "employment_rule",
    "keep_latest", "site_area_join", "site_area_join_shaped", "adjacency", "mines_located", "generators_located",
    "adjacent_records", "coal_rule_tract", "brownfield_rule", "acreage_three_ways", "exact_median",
    "all_rules", "county_report", "site_area_join_many_vertices", "exact_sums", "load_rejects", "zipped_members",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    warm_runs = int(os.environ.get("BENCH_WARM_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("areaqual-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, cold = {}, {}
    for name in names:
        runs = []
        for _ in range(1 + warm_runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        cold[name] = round(runs[0], 3)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: cold {cold[name]} warm {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
