"""Headline-job timings: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each job runs its whole plan into Spark's ``noop`` sink (full execution, no
collect to the driver); the reported figure is wall seconds per job and
their sum. Every job is first run once on the smallest test scale so that
JVM class loading and code generation are not counted (steady-state timing).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weft.plans.registry import all_queries  # noqa: E402
from weft.session import local_session  # noqa: E402

HEADLINE = [
    "c9_assemble_context",
    "b6_knn_cosine",
    "b9_knn_filtered",
    "e14_analyze_corpus",
    "f11_validation_report",
    "g1_stratified_split",
    "h9_render_corpus",
    "j6_pages_to_documents",
    "d6_user_history",
    "d7_expire_history",
    "d10_keyword_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="weft-bench")
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    for name in names:
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
