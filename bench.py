"""Time the main queries; prints one JSON line.

BENCH_SF_DIR  folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default: all)
BENCH_RUNS    timed runs per query after a warm-up of all queries (default 3)

A run covers building the plan, the intermediates it writes and every result
row; results go to a sink that discards them. The value is the sum of medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from laureate.queries import QUERIES  # noqa: E402

HEADLINE = (
    "q_report_index",
    "q_report_champions",
    "q_report_genre",
    "q_report_items",
    "q_agg_year_profile",
    "q_agg_genre_year",
    "q_join_tolerance",
    "q_join_flag",
    "q_win_dedup",
    "q_win_topk",
    "q_win_rank_era",
    "q_waterfall",
    "q_view_matrix",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # The default keeps too few compiled stages for all queries together.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(query, spark: SparkSession, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    seconds = {}
    for name in HEADLINE:
        timed(QUERIES[name], spark, sf_dir)
    for name in HEADLINE:
        each = [timed(QUERIES[name], spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(each), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
