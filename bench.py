"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three warm runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = ("class_scan_part", "poly_scan_party", "get_by_id", "batch_get_ordered", "hash_lookup_4", "hash_dup_check", "range_after_2", "range_backward_top10", "range_follow", "follow_ref_chain", "inverse_count", "inverse_multiset", "graph_depth_k", "array_remove_first", "knn_l2", "knn_batch_cos", "latest_state", "cascade_closure", "set_null_result", "upsert_result", "delete_objects", "object_graph", "conflict_rows")
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from orebase.queries import QUERIES

    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(1 + RUNS):  # the first run warms up
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        took[name] = round(median(seconds[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
