"""Headline queries at one scale; prints one JSON line.

Wall time of each query from building the plan to its last row, and the
number of Spark jobs it ran. Results go to the ``noop`` sink where they are
rows of the input's size.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftspark.catalog import QUERIES  # noqa: E402
from driftspark.session import local_session  # noqa: E402

HEADLINE = [
    "ks_exact", "ks_points_sketch", "convergence", "adaptive_sample", "adaptive_sample_fixed_columns",
    "w1_exact", "swd", "swd_by_window", "swd_null", "split_tiles", "split_modulo", "subwindows",
    "shuffled_rank", "sample_rows", "exact_quantiles", "auc_by_model", "soft_vote", "class_distribution",
    "feature_moments", "publish_rows", "stream_json_files", "stream_window_stats", "train_best",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    tracker = spark.sparkContext.statusTracker()
    # start the engine, so that the first query is not charged for it
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds, jobs = {}, {}
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "jobs": jobs, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
