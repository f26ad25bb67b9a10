"""Batch and streaming readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import prepare

CANONICAL = {
    "tasks": "id string, parent_id string, plan_id string, capability string, state string, issued_by string, "
    "issued_at timestamp, assigned_node string, completed_by string, started_at timestamp, finished_at timestamp",
    "task_events": "task_id string, state string, at timestamp, source string, output_preview string",
    "task_results": "task_id string, output string, error string, completed_at timestamp, completed_by string, "
    "provenance string, cost_usd double",
    "leases": "lease_id string, task_id string, worker_id string, state string, issued_at timestamp, "
    "expires_at timestamp, attempt int",
    "checkpoints": "plan_id string, node_id string, input_hash string, task_id string, output string, created_at timestamp",
    "audit_log": "node_id string, seq bigint, at_ms bigint, action string, subject string, detail string, actor string, "
    "prev_hash string, entry_hash string, received_at_ms bigint",
    "audit_peer_heads": "pin_no bigint, node_id string, seq bigint, entry_hash string, at_ms bigint, sig string, "
    "first_seen_ms bigint, observed_at_ms bigint, status string",
    "audit_ingest_runs": "node_id string, target_seq bigint, from_seq bigint, through_seq bigint, complete boolean",
    "heartbeats": "node_id string, seq bigint, ts timestamp, queue_depth int, cpu_busy_pct int, cpu_pinned_count int, "
    "ram_used_mb bigint, ram_total_mb bigint, gpu_used_mb bigint, gpu_total_mb bigint, in_flight array<string>, "
    "leader_belief string, brain_score int, on_battery boolean, paused boolean",
    "node_manifests": "node_id string, hostname string, os string, arch string, cpu_cores int, ram_total_mb bigint, "
    "gpu_vram_mb bigint, capabilities array<string>, scopes array<string>",
    "partials": "task_id string, seq bigint, stream string, line string",
    "contributions": "request_id string, node_id string, status string, duration_ms bigint, output string, error string",
    "plan_nodes": "plan_id string, node_id string, capability string, input string, timeout_ms int",
    "plan_edges": "plan_id string, from_id string, to_id string",
    "documents": "scope string, path string, content string, mtime timestamp, size_bytes bigint",
    "messages": "message_id string, channel string, sender string, body string, opt_out_type string, received_at timestamp",
    "usage": "task_id string, model string, prompt_tokens bigint, completion_tokens bigint",
}

# Tables of the test data.  Naming ``timestamp`` for their zone-less times reads them as UTC and keeps filters on
# them pushable, which a cast after the scan would not.
SAMPLE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A canonical table stored as ``<folder>/<name>.parquet`` (a file or a folder of files)."""
    return prepare(spark).read.schema(schema or CANONICAL[name]).parquet(f"{folder}/{name}.parquet")


def read_sample(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name, SAMPLE[name])


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a scan has fewer splits than that, as a single small file does.

    For work that is heavy per row.  A scan with enough splits is left alone, so large inputs pay no shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def read_stream(
    spark: SparkSession, folder: str, name: str, schema: str | None = None, files_per_trigger: int = 64
) -> DataFrame:
    """The same table as a stream of arriving files; the trigger size bounds the rows per micro-batch."""
    reader = prepare(spark).readStream.schema(schema or CANONICAL[name]).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", True).parquet(f"{folder}/{name}.parquet")
