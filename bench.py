"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from commerce_lake.plans import QUERIES

HEADLINE = [
    "build_search_docs", "build_vocabulary", "build_facet_values", "search_batch", "facets", "suggest", "fuzzy_candidates", "similar", "trending", "build_cooccurrence", "frequently_bought",
    "summary_report", "top_queries", "daily_trend", "rollup_daily", "hybrid_summary", "attribute_carts", "monotonic_upsert", "apply_delta_facets", "resolve_merch_plan", "bundle_totals", "availability_transitions", "redact_pii",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as tmp:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp}/shared").config("spark.sql.warehouse.dir", f"{tmp}/wh").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # starts the JVM
        took = {}
        for name in HEADLINE:
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
