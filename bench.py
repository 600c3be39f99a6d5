"""Times the registered queries end to end and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an optional
comma-separated selection, ``BENCH_REPEAT`` the timed runs per query after one warm-up of the
session. Every query is run completely: all columns of all rows go to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.plans.catalog import QUERIES  # noqa: E402
from ledgerlake.session import build_session, ship_package  # noqa: E402

HEADLINE = [
    "silver_transactions", "totals_by_category", "category_spend_full", "silver_between",
    "balance_lookup", "recent_transactions", "category_spend", "request_dispatch",
    "merge_accounts", "version_diff", "scd2_sequenced", "scd2_merge", "pit_join", "asof_attributes",
    "usage_running_totals", "chunk_documents", "bm25_topk", "vector_topk", "hybrid_rrf",
    "conversation_docs", "gen_transactions", "stream_scd2", "stream_totals",
]


def seconds(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = build_session("bench", f"local[{cpus}]", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    seconds(QUERIES["totals_by_category"], spark, folder)
    times = {
        name: round(statistics.median(seconds(QUERIES[name], spark, folder) for _ in range(repeat)), 3)
        for name in names
    }
    result = {
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
