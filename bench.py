"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "url_parse", "features_v1", "features_v2", "features_v3", "features_v4", "features_v5", "features_v6",
    "features_v7", "score_heuristic", "join_whitelist_suffix", "join_brand_similarity", "nearest_brand",
    "rule_score", "hybrid_verdict", "hybrid_verdict_no_stage2", "join_stage2_scores", "config_sweep",
    "verdict_stage_counts", "batch_verdicts", "dedup_keep_first", "antijoin_existing_urls", "shuffle_seeded",
    "roc_auc", "pr_curve", "threshold_for_recall", "classification_report", "corpus_build",
    "detect_generated_squats", "nav_ttl_dedup", "nav_verdicts", "page_link_verdicts",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from lurewatch.plans.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # warm up
    times: dict[str, float] = {}
    build: dict[str, float] = {}  # seconds until the plan is handed over; what comes after is its run
    for name in names:
        start = time.perf_counter()
        plan = QUERIES[name](spark, sf_dir)
        build[name] = round(time.perf_counter() - start, 3)
        plan.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    n_urls = QUERIES["union_corpora"](spark, sf_dir).agg({"n": "sum"}).first()[0]
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "build": build, "sf": os.path.basename(sf_dir.rstrip("/")), "corpus_urls": n_urls,
        "verdict_urls_per_second": round(n_urls / times["hybrid_verdict"]) if "hybrid_verdict" in times else None}))


if __name__ == "__main__":
    main()
