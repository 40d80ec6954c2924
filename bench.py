"""Headline queries, timed warm; prints one JSON line.

Raw files that a query reads are written before its clock starts; their times
are under ``fixtures``.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. ``BENCH_RUNS`` (3) is
the number of timed runs per query after one warm-up; the median counts. Every
query runs into the noop sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loopweave.catalog import QUERIES  # noqa: E402
from loopweave.catalog.registry import KEPT, Fixtures  # noqa: E402
from loopweave.session import local_session  # noqa: E402
from loopweave.sources.writers import discard  # noqa: E402

HEADLINE = [
    "a01_station_day_profiles", "a01_profiles_five_minute", "a08_slow_half_hours",
    "a15_most_common_tuple", "a18_nan_aware_covariance", "a19_sample_covariance",
    "a23_histogram_2d", "a27_bucket_below_day_share", "j05_station_version_closed",
    "j08_lane_observation_join", "j11_incident_near_weather_station", "j19_point_in_polygon",
    "m01_pca_fit", "m02_project", "m04_reconstruction_error",
    "m07_kmeans_on_coefficients", "m09_lloyd_step", "m08_cost_curve", "m10_kmeans_outliers", "m10_converged_outliers", "m11_mahalanobis", "m15_linear_regression", "m15_regression_per_group", "m17_regression_features",
    "n01_largest_speed_change", "n02_rainy_monday_throughput", "n04_fastest_and_slowest_freeways",
    "n07_freeway_dips", "n08_similar_freeways", "n09_regression_extract", "n12_station_dimension",
    "n14_observation_fact", "n15_hourly_precipitation", "n16_enriched_stations",
    "n12_incremental_history", "n18_station_profiles",
    "p24_explode_precipitation", "q02_lane_valid", "s01_read_station_5min",
    "w01_effective_end", "w02_first_of_sorted_duplicates", "w05_dense_surrogate_ids",
    "x02_tumbling_averages", "x04_changing_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "loopweave-bench")
    Fixtures.keep = True
    timings = {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            discard(QUERIES[name](spark, sf_dir))
            taken.append(time.perf_counter() - begin)
        timings[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median warm query times", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))[2:],
        "cpus": cpus, "fixtures": {name: seconds for (name, _), (_, seconds) in KEPT.items()}}))


if __name__ == "__main__":
    main()
