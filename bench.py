"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up, then twice; the faster run counts. Results go to a sink that
discards them, so the whole table is computed and nothing is gathered.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "chunks",
    "bm25_topk",
    "vector_topk",
    "guaranteed_order",
    "spread_sample",
    "pii_report",
    "figure_candidates",
    "grounded_answers",
    "history_plan",
    "metric_summary",
    "quota_decisions",
    "rate_limited",
    "subscription_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from checks.queries import REGISTRY
    from parchment.session import local_session

    spark = local_session(cpus)
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        runs = []
        for _ in range(3):
            started = time.time()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(min(runs[1:]), 2)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
