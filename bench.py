"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "index_build", "hybrid_search", "hybrid_filtered", "grounded_verdict", "knn_exact", "knn_filtered", "keyword_rank",
    "term_table", "citations", "context_block", "guest_in_message", "embed_passages", "front_matter",
    "turns_roundtrip_header", "sponsor_flags", "chunk_pack", "duplicate_sources", "changed_sources",
    "kb_checks", "sample_reachable", "session_list", "session_detail", "history_window", "turn_citations",
    "guard_audit", "cited_numbers", "rubric", "markup_findings", "markdown_clean", "html_clean",
    "retrieval_summary", "scenario_eval", "latency_summary", "request_summary",
)


def main() -> None:
    from turnstone.plans import catalog
    from turnstone.plans.catalog import search
    from turnstone.session import builder

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (builder("bench", f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # Start the session and its Python workers before the clock.
    spark.range(0, 1000, 1, int(cpus)).mapInArrow(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        if name == "index_build":  # what ingestion stores once; the searches read it
            search.stored_index(spark, sf_dir)
            seconds[name] = round(time.perf_counter() - start, 3)
            continue
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    out = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
           "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
    if "hybrid_search" in seconds:
        out["searches_per_second"] = round(questions / seconds["hybrid_search"], 2)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
