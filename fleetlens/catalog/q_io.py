"""Queries that go through a sink or a user function."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes
from fleetlens.catalog.registry import query
from fleetlens.operators.scoring import batch_score
from fleetlens.session import checkpoint_dir
from fleetlens.sources import export, upsert
from fleetlens.sources.tables import SAMPLE, read_sample, read_stream


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-{uuid.uuid4().hex}"


@query("export_json_a6", "SELECT event_id, user_id, event_type, value FROM events")
def export_json_a6(spark, d):
    """Events written as JSON lines and read back."""
    folder = _folder(spark)
    export.export_json(read_sample(spark, d, "events").select("event_id", "user_id", "event_type", "value"), folder)
    return spark.read.schema("event_id bigint, user_id bigint, event_type string, value double").json(folder)


@query(
    "export_audit_csv_a5",
    f"{ctes('audit')} SELECT node_id AS node, seq::VARCHAR AS seq, action, actor, subject, detail FROM audit",
)
def export_audit_csv_a5(spark, d):
    """The audit log written as CSV and read back."""
    folder = _folder(spark)
    export.export_audit_csv(b.audit(spark, d).withColumn("entry_hash", F.lit("")), folder)
    columns = "at_utc string, node string, seq string, action string, actor string, subject string, detail string, entry_hash string"
    back = spark.read.schema(columns).options(header=True, escape='"').csv(folder)
    return back.select("node", "seq", "action", "actor", "subject", "detail")


@query(
    "stream_upsert_a7",
    "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def stream_upsert_a7(spark, d):
    """Events streamed into a table that keeps the newest row per user."""
    folder = _folder(spark)
    stream = read_stream(spark, d, "events", SAMPLE["events"]).select("user_id", "event_id", "event_type")
    q = (
        stream.writeStream.foreachBatch(upsert.sink_upsert(f"{folder}/table", ["user_id"], ["event_id"], buckets=8))
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return upsert.read_upserted(spark, f"{folder}/table")


@query("batch_score_g12", "SELECT conv_id, turn, length(text) + length(role) AS score FROM conversations")
def batch_score_g12(spark, d):
    def measure(batches):
        for batch in batches:
            sizes = batch["text"].str.len() + batch["role"].str.len()
            yield pd.DataFrame({"fingerprint": batch["fingerprint"], "score": sizes.astype("int64")})

    c = read_sample(spark, d, "conversations")
    return batch_score(c, measure, ["role", "text"], "score long").select("conv_id", "turn", "score")
