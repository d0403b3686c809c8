"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_RUNS (timed runs, median), BENCH_QUERIES
(comma list). Every query runs once untimed first; results go to Spark's noop sink, so all
rows and columns are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidegrid.plans import QUERIES
from tidegrid.session import build_session

HEADLINE = [
    "wrmsse_by_level",
    "hierarchy_rollup",
    "grid_by_series",
    "rolling_shifted",
    "rolling_several_shifts",
    "rolling_quantiles",
    "ewm_means",
    "nonzero_share",
    "days_since_last_sale",
    "price_momentum",
    "price_stats",
    "target_encodings",
    "trailing_weights",
    "base_and_target_day_calendar",
    "training_instances",
    "naive2",
    "blended_quantiles",
    "metrics_total",
    "rolling_residuals",
    "bin_global",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark__sql__shuffle__partitions": cpus,
            "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false",
            "spark__driver__memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
