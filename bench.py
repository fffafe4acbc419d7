"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("ir_edges", "dominators", "control_deps", "influence", "tier_score", "instruments", "flagship", "rank01", "spans", "resolve_callee", "file_score", "verdict", "auc", "ridge_gram")


def main() -> None:
    from pyspark.sql import SparkSession

    from cairn import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = queries.flagship if name == "flagship" else queries.QUERIES[name]
        began = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    functions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "functions": functions, "functions_per_sec_panel": round(functions / took["flagship"], 1)}))


if __name__ == "__main__":
    main()
