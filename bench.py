"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A warm-up pass over the smallest fixture runs first (JIT, Python workers), so
the timings reflect steady-state query cost rather than process start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storyloom import catalog  # noqa: E402
from storyloom.session import build_session  # noqa: E402

HEADLINE = [
    "weekly_narratives", "near_dup_pairs", "medoids", "coherence", "kmeans_lloyd",
    "silhouette_exact", "key_terms", "textrank", "statements_parse", "feed_normalise",
    "timeline_page", "week_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    qs = catalog.queries()
    names = [n for n in HEADLINE if n in qs]
    warm_dir = "/root/testdata/sf0.001"
    if os.path.isdir(warm_dir):
        for n in names:
            qs[n](spark, warm_dir).collect()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).collect()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
