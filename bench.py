"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_topk", "vector_topk", "hybrid_rrf", "multi_model_fusion", "overlap_topk", "neighbor_chunks", "packed_context",
    "classified_changes", "content_duplicates", "version_history", "char_chunks", "sandwich_chunks", "recursive_chunks",
    "extracted_pages", "answer_verdicts", "run_summary", "latency_and_cost", "located_evidence", "log_counts",
    "usage_by_model", "credit_ledger", "folder_depths", "hourly_rates", "edit_sessions",
]


def main() -> None:
    from corpusmill import get_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session(
        "corpusmill-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from corpusmill.plans import QUERIES

    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("count(*)", "max(length(text))").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
