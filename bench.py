"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Each query runs once to warm up and then BENCH_RUNS (default 3) times; the median counts. Every
output column is computed (noop sink), nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailmark.plans import QUERIES, load_all
from trailmark.session import build_session

HEADLINE = [
    "accuracy_summary", "compare_runs", "describe_numeric", "tool_call_table", "labeled_image_results",
    "calls_with_next_think", "jaccard_best_match", "mixed_result_page", "sft_samples", "rl_samples",
    "overlong_filter", "truncate_reasoning", "geo_reward", "math_answer_line", "group_advantage",
    "best_of_group_advantage", "optimal_token_baseline", "generalized_advantage", "offpolicy_metrics",
    "rejection_mask", "importance_weight_stats", "validation_metrics", "majority_value", "capped_classes",
    "seeded_sample", "resampled_by_score", "aggregated_steps", "bbox_geometry",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    load_all()
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
