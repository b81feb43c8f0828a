"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma-separated
names) choose what runs where.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from basketspark.catalog import all_queries

HEADLINE = [
    "cancel_sign_check",
    "match_cancellations",
    "clean_lines",
    "describe_lines",
    "histogram_sale",
    "box_stats_quantity_by_country",
    "monthly_stats",
    "country_stats",
    "top_purchased",
    "word_frequency_documents",
    "customer_profile",
    "dbscan",
    "single_linkage_cut",
    "k_distance",
    "kmeans_fixed_start",
    "silhouette_exact",
    "davies_bouldin",
    "classification_table",
    "naive_bayes",
    "knn_manhattan_distance",
    "smote",
    "sequentialize",
    "pair_support",
    "gsp_untimed",
    "gsp_min_gap",
    "constraint_sweep_max_gap",
    "pattern_mean_quantity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("basketspark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # start the JVM paths and the Python workers outside the measured part
    spark.range(1000).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
