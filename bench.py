"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fleetlens.catalog import load

HEADLINE = [
    "cost_totals_d9",
    "cost_rows_c1",
    "plan_costs_d10",
    "price_usage_c8",
    "budget_verdicts_e1",
    "merge_concat_d1",
    "merge_dedupe_d2",
    "merge_top_k_d3",
    "merge_aggregate_d5",
    "failure_summary_d8",
    "lww_latest_d14",
    "lease_at_c15",
    "illegal_transitions_e16",
    "verify_chain_e3",
    "corroborate_e14",
    "find_forks_c16",
    "build_index_f1",
    "search_all_f3",
    "search_phrase_f4",
    "grep_b1",
    "federated_search_f6",
    "embed_lookup_k2",
    "evaluate_rules_c17",
    "pick_candidate_c11",
    "topo_layers_h2",
    "validate_plans_h1",
    "resolve_refs_c13",
    "reject_replays_g1",
    "suppress_bursts_g8",
    "coalesce_requests_g11",
    "success_rate_e26",
    "breaker_g13",
    "windowed_load_g14",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # One small query first, so that start-up is not charged to the first measurement.
    queries["count_by_state_d11"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
