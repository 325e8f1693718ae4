"""Time the headline queries and print one JSON line.

Each query runs in full into a sink that discards the rows; the time is the
median of the measured runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from terrachron.registry import load
from terrachron.session import local_session

HEADLINE = [
    "boundary_interval_merge",
    "boundary_lines",
    "transport_lines_override",
    "routes_normalized",
    "routes_indexed",
    "languages_search",
    "tag_mapping_scan",
    "skip_reason",
    "interval_overlap_join",
    "distinct_on",
    "set_hash",
    "areas_view",
    "simplify_job",
    "label_point_job",
    "tile_features",
    "tile_expand_parents_children",
    "apply_changes",
    "augmented_diff",
    "merge_by_changeset",
    "element_presence",
    "stateful_retry",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run_once(build, spark, folder: str) -> float:
    began = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times = {}
    for name in names:
        run_once(queries[name], spark, folder)
        runs = [run_once(queries[name], spark, folder) for _ in range(RUNS)]
        times[name] = round(statistics.median(runs), 3)
    result = {
        "metric": "total time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
