"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1) and
prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is built and executed in full (noop sink, no collect to the
driver) ``$BENCH_REPEAT`` times (default 3); a query's time is its best run
(the VM's timings are noisy), and the value is the sum over queries. One
warm-up query runs first (JIT, file listing caches).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadence.plans.registry import QUERIES  # noqa: E402
from cadence.session import local_session  # noqa: E402

HEADLINE = [
    "yoy_growth",
    "qoq_growth",
    "insight_yoy",
    "insight_qoq",
    "growth_view_qoq",
    "format_growth_table",
    "entity_catalog",
    "category_store_rules",
    "coerce_or_zero",
    "load_file_profile",
    "load_store_profile",
    "store_append_new",
    "fn_safe_name",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    run(QUERIES["agg_annual"](spark, sf_dir))  # warm-up: JIT, file listing caches
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    times = {}
    for k in keys:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(QUERIES[k](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[k] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
