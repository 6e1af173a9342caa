"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from winnow.plans import checks, matrices
from winnow.session import local_session

HEADLINE = [
    "dedup_rows", "stratified_split", "chronological_split", "fs_eval_sample", "stratified_kfold",
    "column_summary", "numeric_describe", "corr_top_pairs", "target_encode_oof", "feature_engineer",
    "average_precision", "metrics_by_split", "linear_shap_importance", "permutation_importance", "frontier_sweep",
    "candidate_cap", "metrics_table", "fs_ensemble", "shap_importance", "permutation_importance_trees", "train_eval_sets",
    "run_experiment",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    queries, took = checks.all_queries(), {}
    began = time.perf_counter()
    matrices.orders_matrix(spark, sf_dir).count()
    took["build_orders_matrix"] = time.perf_counter() - began
    for name in chosen:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = time.perf_counter() - began
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in took.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
