"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from siftwell.plans import registry

HEADLINE = ["hybrid_search", "bm25_topk", "knn_topk", "knn_query_set", "rrf_fusion", "scoring_pipeline", "confirmation_gate", "source_engagement", "exact_dedup", "word_jaccard", "topic_cooccurrence", "ctfidf_labels", "gap_sessions", "daily_volume_z", "chain_shape", "cross_project_packages", "top_customers", "url_canonical", "html_strip", "semantic_boost"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp()}").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    registry.entry(spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
