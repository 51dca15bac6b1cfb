"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of median seconds, each query warmed up once.

Each query's seconds go to stderr as it ends; a query that has taken $BENCH_QUERY_SECONDS is not repeated, and its warm-up counts if it took that alone.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from recallforge.plans.registry import queries

HEADLINE = ("bm25_topk", "dense_topk", "structured_topk", "fusion_content_dedup", "sliding_windows", "keyword_jaccard_pairs", "apply_decisions", "judge_report_grouping_sets")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    repeats, limit = int(os.environ.get("BENCH_REPEATS", "3")), float(os.environ.get("BENCH_QUERY_SECONDS", "60"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.openCostInBytes", "256k").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, took = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + repeats):
            if sum(times) > limit:
                break
            began = time.perf_counter()
            registered[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:] or times), 3)
        print(name, took[name], f"({len(times)} runs)", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "spark": spark.version, "cpus": int(cpus), "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
