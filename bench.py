"""Headline queries, timed: one warm-up, then the median of a few runs.

Prints one JSON line.  Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and
BENCH_CPUS (default 8); BENCH_RUNS sets the number of timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from foliospark.plans.registry import load_all
from foliospark.session import local_session

HEADLINE = [
    "sel_nested",
    "topk",
    "assemble_context",
    "build_messages",
    "val_first_error",
    "parse_configs",
    "upd_set",
    "agg_messages",
    "win_batches",
    "stream_iterations",
]


def timed(spark, query, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "bench")
    queries, _ = load_all()
    seconds = {}
    for name in HEADLINE:
        timed(spark, queries[name], sf_dir)
        seconds[name] = round(statistics.median(timed(spark, queries[name], sf_dir) for _ in range(runs)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
        "runs": runs,
        "spark": spark.version,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
