"""Time the headline queries on one machine and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` an
optional comma-separated choice of queries (``all`` for every registered one). Each query
is run to the end, every row and column, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "join_filter_agg", "join_filter_agg_grouped", "join_filter_agg_topn", "join_two_inner",
    "join_two_outer", "join_chain", "join_multi_key", "denormalize", "aggregate_basic",
    "aggregate_lines", "aggregate_first_last", "aggregate_concat", "aggregate_nunique_std_median",
    "rank_row_number", "rank_min", "rank_global_rank", "rank_top_rank", "dedup_first",
    "dedup_none", "dedup_report", "delta_full_delta", "union_by_name", "filter_where_builder",
    "route_rules_multi", "route_values_first_match", "column_split_null_separate",
    "split_by_value_written", "nulls_mean", "nulls_mode", "nulls_ffill", "null_audit",
    "cast_nullify", "cast_errors", "profile_columns", "csv_pipe_roundtrip", "zip_member_scan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = (list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the JVM code paths is not part of any query.
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
