"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from knotwork.plans.queries import QUERIES

HEADLINE = [
    "most_connected",
    "undirected_degrees",
    "graph_summary",
    "audit_summary",
    "with_names",
    "resolve_names",
    "bfs_depths",
    "bfs_hubs",
    "find_connections",
    "bm25_topk",
    "vector_topk",
    "search_observations",
    "mention_links",
    "upsert_entities",
    "upsert_relationships",
    "delete_entities",
    "merge_entities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "20g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))  # one machine only
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["graph_counts"](spark, sf_dir).collect()  # start the JVM and the Python workers
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
