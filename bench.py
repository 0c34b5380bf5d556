"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. Each is run once to warm up, then median of three."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from millrace import catalogue

HEADLINE = [
    "flagship", "count", "filter_compare", "filter_starts_ends_contains", "sort_chained", "topk", "join_inner", "join_left", "join_count",
    "distinct", "sum", "min_max", "to_group", "nearest_k", "search_index_rows", "search_any", "search_all", "view_mirror_diff", "view_history",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalogue.queries(), {}
    for name in HEADLINE:
        each = []
        for turn in range(4):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
