"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to a no-op sink, so every row is computed and none is
pulled to the driver. The first pass warms JVM and Python workers; the second
is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framepair.catalog import QUERIES
from framepair.session import build_session

# Pairing, splits, scoring, kernels, translation, calibration, whole jobs.
HEADLINE = [
    "nearest_on_grid", "extract_pairs", "nearest_irregular", "nearest_all_events", "stream_timing",
    "chunk_split", "session_split_even", "pairs_by_name", "decoupled_drawn",
    "scored_pairs", "score_summary", "frame_profile", "intensity_histogram",
    "gaussian_blur", "edge_map", "warped_frames", "paired_samples",
    "translated_frames", "translated_conditions", "fitted_homography", "registered_frames", "session_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "framepair-bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    took: dict[str, float] = {}
    for _ in range(2):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
