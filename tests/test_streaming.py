"""Every streaming operator gives what its batch twin gives."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.operators import first_record as fr
from fleetlens.operators import lifecycle as lc
from fleetlens.operators import telemetry as te
from fleetlens.streaming import streams as st

DAY = 86_400_000


def as_stream(spark, df, tmp_path, order, parts=4):
    """``df`` as files that arrive one after another in ``order``."""
    folder = str(tmp_path / uuid.uuid4().hex)
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, stream, tmp_path):
    name = "q" + uuid.uuid4().hex
    q = (
        stream.writeStream.format("memory")
        .queryName(name)
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / ("c" + name)))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(300)
    return spark.table(name)


def same(got, want, columns):
    pick = lambda df: sorted((tuple(str(v) for v in r) for r in df.select(*columns).collect()))
    assert pick(got) == pick(want)
    assert got.count() > 0


def test_reject_replays(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf)
    frames = h.select("node_id", F.lit("c").alias("channel"), F.col("seq").alias("arrival"), F.col("k").alias("seq"))
    got = run(spark, st.reject_replays(as_stream(spark, frames, tmp_path, "arrival")), tmp_path)
    same(got, te.reject_replays(frames), ["node_id", "arrival", "accepted"])


def test_membership_events(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf).select("node_id", "seq", F.date_trunc("second", "ts").alias("ts"))
    end = h.select(F.lit("zz").alias("node_id"), F.lit(10**9).alias("seq"), F.lit("2024-03-01").cast("timestamp").alias("ts")).limit(1)
    got = run(spark, st.membership_events(as_stream(spark, h.unionByName(end), tmp_path, "seq"), DAY), tmp_path)
    want = te.membership_events(h, F.lit("2024-03-01").cast("timestamp"), DAY).withColumn("at_ms", F.unix_millis("at"))
    same(got.filter("node_id <> 'zz'"), want, ["node_id", "kind", "at_ms"])


def test_apply_lww(spark, sf, tmp_path):
    e = b.task_events(spark, sf).withColumn("ts", F.col("at"))
    got = run(spark, st.apply_lww(as_stream(spark, e, tmp_path, "event_id")), tmp_path)
    last = got.groupBy("task_id").agg(F.max_by("state", F.struct(F.array_position(F.array(*[F.lit(s) for s in lc_states()]), "state"), "at_ms", "source")).alias("state"))
    same(last, lc.lww_latest(e), ["task_id", "state"])


def lc_states():
    from fleetlens.vocab import STATES

    return STATES


def test_pause_latch(spark, sf, tmp_path):
    d = b.heartbeats(spark, sf).select("node_id", "ts", "seq", F.col("load").alias("depth"))
    got = run(spark, st.pause_latch(as_stream(spark, d, tmp_path, "seq"), 60, 5), tmp_path)
    want = te.pause_latch(d.select("node_id", F.col("ts").alias("at"), "seq", "depth", F.lit(False).alias("operator_pause")), 60, 5)
    same(got, want, ["node_id", "seq", "latched"])


def test_state_changes(spark, sf, tmp_path):
    e = b.task_events(spark, sf).withColumn("ts", F.col("at"))
    got = run(spark, st.state_changes(as_stream(spark, e, tmp_path, "event_id")), tmp_path)
    same(got, lc.state_changes(e), ["task_id", "event_id", "previous", "state"])


def test_suppress_bursts(spark, sf, tmp_path):
    a = b.audit(spark, sf).select(F.lit("shell.denied").alias("action"), "actor", F.col("seq").alias("row_id"), "at_ms", "subject")
    rows = a.withColumn("ts", F.timestamp_millis("at_ms"))
    end = rows.limit(1).withColumns({"actor": F.lit("zz"), "ts": F.lit("2024-06-01").cast("timestamp"), "row_id": F.lit(10**9).cast("long")})
    got = run(spark, st.suppress_bursts(as_stream(spark, rows.unionByName(end.select(*rows.columns)), tmp_path, "row_id"), DAY, 3), tmp_path)
    want = fr.suppress_bursts(a, DAY, 3)
    columns = ["kind", "actor", "row_id", "at_ms", "suppressed_repeats", "distinct_subjects", "distinct_subjects_capped"]
    same(got.filter("actor <> 'zz'"), want, columns)
    joined = [F.concat_ws("|", "sample_subjects").alias("s")]
    pick = lambda df: sorted(str(r) for r in df.filter("kind = 'summary' and actor <> 'zz'").select("actor", "at_ms", *joined).collect())
    assert pick(got) == pick(want)


def test_rate_limit(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf)
    rq = h.select(F.col("event_type").alias("key"), "ts", F.unix_millis("ts").alias("at_ms"), F.col("seq").alias("arrival"), F.col("seq").alias("request_id"))
    got = run(spark, st.rate_limit(as_stream(spark, rq, tmp_path, "arrival"), 4, DAY), tmp_path)
    same(got, fr.rate_limit(rq, 4, DAY), ["key", "request_id", "admitted", "dropped_before"])


def test_coalesce_requests(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf)
    rq = h.select(F.col("event_type").alias("fingerprint"), "ts", F.unix_millis("ts").alias("at_ms"), F.col("seq").alias("request_id"))
    end = rq.limit(1).withColumns({"fingerprint": F.lit("zz"), "ts": F.lit("2024-06-01").cast("timestamp"), "request_id": F.lit(10**9).cast("long")})
    got = run(spark, st.coalesce_requests(as_stream(spark, rq.unionByName(end), tmp_path, "request_id"), DAY, 5), tmp_path)
    want = fr.coalesce_requests(rq, DAY, 5, chunk_rows=32)
    same(got.filter("kind = 'member' and fingerprint <> 'zz'"), want, ["fingerprint", "request_id", "batch_no"])
    same(got.filter("kind = 'sent' and fingerprint <> 'zz'"), want.select("fingerprint", "batch_no", "batch_size", "sent_by").distinct(), ["fingerprint", "batch_no", "batch_size", "sent_by"])


def test_breaker(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf)
    o = h.select("node_id", F.date_trunc("second", "ts").alias("ts"), F.col("seq").alias("outcome_id"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    end = o.limit(1).withColumns({"node_id": F.lit("zz"), "ts": F.lit("2024-06-01").cast("timestamp"), "outcome_id": F.lit(10**9).cast("long")})
    got = run(spark, st.breaker(as_stream(spark, o.unionByName(end), tmp_path, "outcome_id"), 3, DAY // 2), tmp_path)
    want = te.breaker(o.withColumn("at", F.col("ts")), 3, DAY // 2).select(
        "node_id", F.unix_millis("benched_at").alias("benched_ms"), F.unix_millis("benched_until").alias("until_ms"), "failures"
    )
    same(got, want, ["node_id", "benched_ms", "until_ms", "failures"])


def test_leader_with_antiflap(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf)
    tick = F.floor(F.unix_millis("ts") / 21_600_000) * 21_600_000
    c = h.groupBy(F.col("event_type").alias("observer"), tick.alias("tick_ms"), "node_id").agg((F.max("k") * 4).alias("score"))
    two = c.groupBy("observer", "tick_ms").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node_id"))), 1, 2).alias("t"))
    at = lambda i, f: F.try_element_at("t", F.lit(i))[f]
    ticks = two.select("observer", "tick_ms", at(1, "node_id").alias("first_id"), (-at(1, "s")).alias("first_score"), at(2, "node_id").alias("second_id"), (-at(2, "s")).alias("second_score"))
    got = run(spark, st.leader_with_antiflap(as_stream(spark, ticks, tmp_path, "tick_ms"), DAY // 2, 50), tmp_path)
    same(got, te.leader_with_antiflap(c, DAY // 2, 50), ["observer", "tick_ms", "leader", "score", "changed"])


def test_dedup_deliveries(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf)
    m = h.select(F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("m"), F.col("k").cast("string"))).alias("message_id"), "ts", F.col("seq").alias("arrival"))
    got = run(spark, st.dedup_deliveries(as_stream(spark, m, tmp_path, "arrival"), "60 days"), tmp_path)
    want = te.dedup_deliveries(m)
    same(got.filter("message_id = ''"), want.filter("message_id = ''"), ["arrival"])
    same(got.filter("message_id <> ''"), want.filter("message_id <> ''"), ["message_id"])


def test_windowed_load(spark, sf, tmp_path):
    h = b.heartbeats(spark, sf).select("node_id", "ts", "load", "seq")
    end = h.limit(1).withColumns({"node_id": F.lit("zz"), "ts": F.lit("2024-06-01").cast("timestamp"), "seq": F.lit(10**9).cast("long")})
    stream = te.windowed_load(as_stream(spark, h.unionByName(end), tmp_path, "seq"), "12 hours", "6 hours", "1 hour")
    want = te.windowed_load(h, "12 hours", "6 hours")
    columns = ["node_id", "window_start", "beats", "max_load"]
    same(run(spark, stream, tmp_path).filter("node_id <> 'zz'"), want, columns)


def test_sink_upsert(spark, sf, tmp_path):
    from fleetlens.sources.upsert import read_upserted, sink_upsert, upsert

    e = b.task_events(spark, sf)
    folder = str(tmp_path / "table")
    q = (
        as_stream(spark, e, tmp_path, "event_id")
        .writeStream.foreachBatch(sink_upsert(folder, ["task_id"], ["at", "event_id"], buckets=4))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(300)
    from fleetlens.operators.ordered import newest_by

    want = newest_by(e, ["task_id"], F.struct("at", "event_id"))
    same(read_upserted(spark, folder), want, ["task_id", "event_id", "state"])
    upsert(e.filter(F.col("event_id") >= 900), folder, ["task_id"], ["at", "event_id"], buckets=4)
    same(read_upserted(spark, folder), want, ["task_id", "event_id", "state"])


@pytest.mark.parametrize("cap", [None, 7])
def test_read_stream(spark, sf, cap, tmp_path):
    from fleetlens.sources.tables import SAMPLE, read_sample, read_stream

    got = run(spark, read_stream(spark, sf, "events", SAMPLE["events"], cap or 64), tmp_path)
    assert got.count() == read_sample(spark, sf, "events").count()
