"""Headline-query timings at one scale factor; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed fully with the ``noop`` sink (every row computed, nothing
collected), once to warm up and once timed; the costly ones once only, and last. The line is
printed anew after every query, with the total so far: a run that is stopped leaves its last line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairlab.plans.catalog import QUERIES  # noqa: E402
from pairlab.session import local_session  # noqa: E402

HEADLINE = [
    "flagship", "lookup_strict", "lookup_lenient", "interaction_features", "standard_scale_fit",
    "stratified_split", "balanced_seed", "evaluate_scores", "evaluate_scores_grouped", "mc_mean",
    "acquire_weighted", "acquire_hybrid", "leaf_proximity", "neighbour_label_agreement",
    "extract_embeddings", "mean_pool", "attention_pool", "learning_curve", "mlp_forward",
    "project_2d", "feature_pipeline", "kmeans_slice", "acquire_badge", "mc_dropout_score", "train_mlp",
]
#: Costly queries that write their own tables while they run: timed once, after a warm session.
ONCE = {"mc_dropout_score", "train_mlp", "kmeans_slice", "acquire_badge", "project_2d", "feature_pipeline"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, driver_memory="16g")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    times = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        if name not in ONCE:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                          "queries": times, "sf": float(m.group(1)) if m else sf_dir}), flush=True)


if __name__ == "__main__":
    main()
