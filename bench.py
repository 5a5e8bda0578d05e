"""Headline timings: runs the main registered queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS] and prints one JSON line. Each query is forced with the no-op sink (whole result
computed, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fd_sampled",          # FD discovery on an exact 50,000-row sample (the reference's measured job)
    "fd_ranked",           # FD discovery on the whole lineitem table
    "fd_composite",        # lhs sets of size 1 and 2
    "profile_table",       # full column profile
    "profile_numeric",
    "profile_percentiles",
    "profile_value_counts",
    "contract_learn",
    "validate_report",
    "histogram_equal_width",
    "describe_numeric",
    "fit_best",
    "ks_expon",
    "synth_table",         # whole synthesis: blueprint + generation
    "alloc_rest_prop",
    "label_exact_rate",
    "req_all",             # request extraction over one request per order
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tabletwin.plans.catalog import QUERIES
    from tabletwin.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="tabletwin-bench")
    # warm-up (not timed): JVM JIT, parquet readers, codegen caches, on the smallest scale factor
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm):
        warm = sf
    for name in ("profile_meta", "fd_ranked", "profile_table"):
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
