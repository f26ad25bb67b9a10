"""Queries that run a stream to its end; their SQL is that of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog import q_lifecycle, q_telemetry  # noqa: F401  (their SQL is stated again)
from fleetlens.catalog.registry import ORACLES, query
from fleetlens.session import new_folder
from fleetlens.streaming import streams as st

DAY = 86_400_000
#: Longer than the test tables last: no key that comes back is forgotten.
LONG = 400 * DAY


def _arriving(df, order: str, parts: int = 3):
    """``df`` as files that arrive one after another in ``order``: a micro-batch takes the files of one part."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "arriving")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)])).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x < F.col(order))) if edges else F.lit(0)
    for k in range(parts):
        df.filter(part == k).repartition(files).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def _ended(stream):
    """What the stream has written when nothing more arrives."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, "ended")
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("stream_replays_g1", f"SELECT node_id, channel, arrival, seq, accepted FROM ({ORACLES['reject_replays_g1']})")
def stream_replays_g1(spark, d):
    h = b.heartbeats(spark, d)
    frames = h.select("node_id", F.col("event_type").alias("channel"), F.col("seq").alias("arrival"), F.col("k").alias("seq"), "ts")
    return _ended(st.reject_replays(_arriving(frames, "arrival"), "400 days", LONG))


@query("stream_membership_g3", f"SELECT node_id, kind, at_us // 1000 AS at_ms FROM ({ORACLES['membership_events_g3']}) WHERE kind <> 'evicted'")
def stream_membership_g3(spark, d):
    """Arrivals; evictions wait for a watermark that a stream's end does not bring."""
    h = b.heartbeats(spark, d).select("node_id", "seq", "ts")
    return _ended(st.membership_events(_arriving(h, "seq"), DAY, "400 days")).filter("kind <> 'evicted'")


@query("stream_pause_g7", f"SELECT node_id, seq, depth, latched FROM ({ORACLES['pause_latch_g7']})")
def stream_pause_g7(spark, d):
    depths = b.heartbeats(spark, d).select("node_id", "ts", "seq", F.col("load").alias("depth"))
    return _ended(st.pause_latch(_arriving(depths, "seq"), 100, 10, "400 days", LONG))


@query("stream_rate_limit_g9", f"SELECT key, request_id, admitted FROM ({ORACLES['rate_limit_g9']})")
def stream_rate_limit_g9(spark, d):
    a = b.audit(spark, d)
    rq = a.select(F.col("actor").alias("key"), F.timestamp_millis("at_ms").alias("ts"), F.col("seq").alias("arrival"), F.col("seq").alias("request_id"))
    return _ended(st.rate_limit(_arriving(rq, "arrival"), 20, q_telemetry._RATE_WINDOW, "400 days", LONG)).select("key", "request_id", "admitted")


@query("stream_state_changes_g15", ORACLES["state_changes_g15"])
def stream_state_changes_g15(spark, d):
    e = b.task_events(spark, d).select("task_id", "state", "event_id", F.col("at").alias("ts"))
    return _ended(st.state_changes(_arriving(e, "event_id"), "400 days", LONG)).select("task_id", "event_id", "previous", "state")
