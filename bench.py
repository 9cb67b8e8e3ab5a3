"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default: the headline set below).
Model fitting is not in the headline set: its cost is the original's 200 sequential boosting
rounds over a ~7k-row daily table, the same at every scale factor
(time it with BENCH_QUERIES=model_results).
Each query is executed in full through the ``noop`` sink (no driver collection).
Before timing, every selected query runs once on the smallest shared tables (sf0.001) to
warm the JVM and the Python workers; the timed runs then read the benchmark tables, which
no earlier run has touched (nothing is cached).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from murmur.plans import catalog  # noqa: E402
from murmur.session import build_session  # noqa: E402

HEADLINE = [
    "liquidity_features", "kalman_smoothing", "daily_bars", "post_engagement", "post_comment_relation",
    "daily_social", "market_social_features", "document_sentiment", "scorer_agreement",
    "score_summary", "scorer_boxes", "daily_text_chunks", "incremental_irony",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q in catalog.QUERIES]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": "16g"})
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names if os.path.isdir(warm_dir) else []:
        catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
