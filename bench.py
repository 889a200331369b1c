"""Headline queries, timed with a noop sink.  Prints one JSON line.

    BENCH_SF_DIR   folder with the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores              (default 8)
    BENCH_RUNS     timed runs per query     (default 2, the best counts)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload import registry  # noqa: E402

HEADLINE = (
    "totals",
    "heatmap",
    "user_stats",
    "reaction_totals",
    "reply_network_edges",
    "session_breaks",
    "author_blocks",
    "recap",
    "day_index",
    "filter_low_activity",
    "redact_documents",
    "norm_text",
    "token_estimate_documents",
    "keyed_dedup",
    "merged_conversation",
    "identity_labels",
    "json_export_scan",
    "txt_export_scan",
    "html_export_scan",
    "txt_layout",
    "html_transcript",
    "newest_first_fill",
    "budget_trim",
    "chunk_bounds",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["timeline"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total best wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
