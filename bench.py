"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then three times; the median counts. All columns of the result
are computed and discarded (the noop sink), so nothing is pruned or collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "html_to_text",
    "budget_chunks",
    "paged_chunks",
    "evidence_rows",
    "ingest_outcomes",
    "extractive_summaries",
    "hash_embeddings",
    "vector_topk",
    "vector_topk_batch",
    "keyword_search",
    "keyword_search_batch",
    "retrieve_dedupe",
    "ask_answers",
    "gate_outcomes",
    "citation_groups",
    "merged_documents",
    "recognised_page_texts",
    "documents_with_progress",
    "reconciled_documents",
    "replaced_evidence",
    "library_stats",
)


def main() -> None:
    from marginalia.plans.catalog import QUERIES
    from marginalia.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(HEADLINE)
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cores)
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rpartition("sf")[2],
            }
        )
    )


if __name__ == "__main__":
    main()
