"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query is written to the no-op sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from feedlake.plans.registry import QUERIES
from feedlake.session import build_session

HEADLINE = (
    "flagship_session_counts",
    "s1_frame_intake",
    "p1_frame_kinds",
    "p5_snapshot_levels",
    "p8_open",
    "p12_matches",
    "p13_s2_rest_books",
    "w2_w5_session_sequence",
    "w6_j4_alignment",
    "w8_liveness_timeouts",
    "a1_frame_accounting",
    "a5_latency",
    "b1_level_book",
    "b1_session_book",
    "b2_resting_orders",
    "j5_maker_fills",
    "c1_encode_levels",
    "c2_decode_orders",
    "c3_c4_requests",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("feedlake-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the JVM, the code generator and the Python workers.
    QUERIES["s1_frame_intake"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(os.path.normpath(sf_dir))
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
