"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from skyfold.plans.registered import QUERIES
from skyfold.session import local_session

HEADLINE = (
    "binned_light_curve",
    "binned_light_curve_volume",
    "min_observations_verdicts",
    "min_observations_volume",
    "check_results_fail_fast",
    "validation_report",
    "csv_export",
    "catalog_ingest",
    "catalog_load",
    "catalog_rejects",
    "catalog_binned",
    "quantities_long",
    "band_arrays",
    "log_numbering",
    "plot_series",
)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores), app_name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["band_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names or HEADLINE:
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        timings[name] = round(best, 3)
    print(
        json.dumps({
            "metric": "headline_queries_total",
            "value": round(sum(timings.values()), 3),
            "unit": "sec",
            "queries": timings,
            "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        })
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
