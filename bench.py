"""Run the headline queries once each and print one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import time

from seekgrain.session import build_session

HEADLINE = (
    "bm25_topk", "dense_topk", "rrf_hybrid", "weight_sweep", "field_bm25_topk", "facet_counts", "hard_filter_and_or",
    "interval_overlap", "bridge_explode_join", "reference_aggregation", "ir_metrics_macro", "quality_ratios",
    "language_by_hints", "display_text", "chunk_pages", "html_text", "policy_resolution", "claim_support_findings",
    "pool_priority", "latency_percentiles",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": cores,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "seekgrain.spread": cores,
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "1m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from suite import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
