"""Headline queries at one scale: prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of cores.
Every query is run to the end without collecting its rows.  One warm-up query
starts the JVM's compilers; the time of a query includes planning it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "page_body_text",
    "page_titles",
    "page_names",
    "canonical_urls",
    "frontier_ranked",
    "frontier_dedupe",
    "search_payloads",
    "content_tokens",
    "email_scan",
    "fetch_results",
    "directory_extract",
    "kv_extract",
    "order_pages",
    "coerce_types",
    "validate_split",
    "entity_dedupe",
    "quality_report",
    "validity_report",
    "lead_backfill",
    "harvest_records",
    "webhook_payloads",
    "csv_roundtrip",
    "event_replay",
    "job_status",
    "stream_dedupe",
    "reply_merge",
    "reply_records",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from recordlake.catalogue import QUERIES
    from recordlake.plans.stages import discard_intermediates

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["validity_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    discard_intermediates(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
