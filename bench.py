"""Time the headline queries on one folder of tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "word_frequency", "topic_assign", "topic_board", "demand_density", "blocklist_filter", "own_text_filter", "keyword_tfidf",
    "viral_rate_by", "tag_performance", "country_rollup", "structure_matrix", "compare_groups", "multi_group", "data_profile",
    "spearman_matrix", "trend_report", "auto_tier", "recent_baseline", "coalesce_upsert", "latest_and_previous",
    "account_features", "reconcile_entities", "duplicate_candidates", "recall", "plain_text", "html_articles",
    "normalized_messages", "window_keywords", "anchored_windows", "new_items_by_head", "ab_segments",
    "merge_leads", "manual_pairs", "new_items_by_quota", "canonical_names",
]


def main() -> None:
    from tidemark.plans import all_queries
    from tidemark.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("tidemark-bench", f"local[{cpus}]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__tidemark__documentPartitions=cpus)  # the bench tables have one row group
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()  # start the JVM paths
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
