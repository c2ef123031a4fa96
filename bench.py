"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ALL=1 for every registered query,
BENCH_QUERIES=a,b for a choice.
"""

from __future__ import annotations

import json
import os
import time

from flowloom.session import local_session
from registry import QUERIES

HEADLINE = [
    "flow_stats", "flow_stats_epoch", "stream_id", "flow_features_per_split", "flow_features_open_world",
    "flow_direction", "cap_packets", "flow_batches", "block_assign", "column_blocks_discrete", "merge_plan_jaccard",
    "apply_merge", "augment_top_k", "tree_edges", "vocab_v2", "encode_packets", "label_map", "split_packets",
    "split_flows", "split_flows_by_length", "sample_flows_long", "sample_hybrid", "balance", "flow_mean_probs",
    "flow_soft_weighted", "flow_topk_mean", "flow_logsumexp", "pool_vectors_attn", "flow_eval", "reject_eval",
    "ngi_per_expert", "consolidate", "field_filter", "pdml_fields",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def warm_up(spark, names: list[str], sf_dir: str) -> None:
    """Every query once on a small table, so that the first ones don't pay for loading and compiling code."""
    for name in names:
        run(spark, name, sf_dir)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    if os.environ.get("BENCH_QUERIES"):
        names = os.environ["BENCH_QUERIES"].split(",")
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    warm_up(spark, names, small if os.path.isdir(small) else sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
