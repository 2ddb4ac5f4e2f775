"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""
from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["street_value_by_region", "divide_at_junctions", "segments", "build_edges", "assign_by_polygon",
            "connected_components", "region_distances", "spanning_tree", "category_shares", "decentral_assets",
            "subprocess_outputs", "decentral_results", "bars", "nearest_region", "close_gaps", "root_tree",
            "region_connections", "query_all", "near_touch_vertices"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="regionflow-"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from regionflow.queries import QUERIES
    QUERIES["total_edge_length"](spark, "/root/testdata/sf0.001").collect()  # warm the session, not the data
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    streets = sum(spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("customer", "supplier"))
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else folder,
                      "streets_divided_per_second": round(streets / seconds["divide_at_junctions"], 1)}))


if __name__ == "__main__":
    main()
