"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_RUNS (default 3, median after
one warm-up run), BENCH_QUERIES (comma-separated names, or all; default HEADLINE).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from millrace.session import build_session
from millrace.suite import everything


# One or two queries per operator family.
HEADLINE = """prepare_join_group rename_cast_fill dedupe_subset join_inner join_hot_keys group_aggregates stack_by_name
    split_rest sample_fraction top_values latest_per_key ordered_position_neighbours ordered_hot_keys ordered_trailing_day
    profile_summary sql_semi_anti sql_rollup sql_aggregates sql_text lineage_staleness lineage_upstream label_floors
    event_tail_stream pii_redact guard_json_shape prompt_render answer_shared_requests search_documents ledger_cost
    usage_by_day budget_status budget_crossing budget_replay audit_verify retention_kept
    ordered_median lineage_levels lineage_rebuild lineage_status versioned_sink pii_iban_checksum answer_rows""".split()


def seconds(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "4"), int(os.environ.get("BENCH_RUNS", "3"))
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    times, queries = {}, everything().queries
    for name in queries if chosen == ["all"] else chosen or HEADLINE:
        seconds(spark, queries[name], sf_dir)
        times[name] = round(statistics.median(seconds(spark, queries[name], sf_dir) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
