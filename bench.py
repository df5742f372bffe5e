"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is fully executed (a ``noop`` write forces every row and
column to be computed without collecting to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedstack.plans import catalog  # noqa: E402
from feedstack.session import local_session  # noqa: E402

HEADLINE = [
    "ingest_batch",          # E1: parse + validate + transform + first-wins + tagging
    "platform_statistics",   # flagship: ingest -> stored -> per-platform aggregate
    "write_rejects",         # K2: explained rejects
    "batch_result",          # A22 per-file counters
    "potential_duplicates",  # N20: group count + semi join
    "dedup_against_store",   # X3: anti join against the store
    "filter_all",            # F9: pushed-down filters
    "page_reviews",          # P1: top-k page
    "review_row_functions",  # R1-R6 over every review
    "hash_functions",        # H1-H11 over documents
    "ledger_current",        # W2 max_by over ledger events
    "job_status",            # L15 over jobs
    "metric_timers",         # A26 percentiles
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    qs = catalog.queries()
    # Warm-up: JIT and code generation on the smallest data set.
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        qs["platform_statistics"](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.time()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
