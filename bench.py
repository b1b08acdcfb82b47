"""Time the headline queries on one machine and print one JSON line.

Each query is run to the end by Spark's no-op sink, so that nothing but the query is timed; one small query first starts
the session and its workers. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores, BENCH_QUERIES some queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "translation_plan", "segment_lines", "segment_ids", "chunk_long_text", "pack_batches", "surrounding_source", "recent_targets", "sample_positions",
    "term_match", "relevant_terms", "term_impact", "alias_conflicts", "conflict_details", "conflict_candidates", "term_upsert_fold", "merge_term_metadata", "signature_groups",
    "progress_by_chapter", "usage_totals", "failure_breaker", "log_tail", "revision_history", "revision_fold", "review_summary", "export_txt", "punctuation_normalize", "xhtml_fallback_blocks", "align_zip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quire.plans import catalogue

    queries = catalogue.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries["version_diff"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
