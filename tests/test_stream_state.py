"""Stream state that goes when keys fall silent, and rows that come late."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from fleetlens.streaming import folds
from fleetlens.streaming import streams as st
from fleetlens.streaming.keyed import SHARDS, FoldProcessor

SECOND = 1_000


def stream_of(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("at")).drop("at").coalesce(1).write.parquet(f"{folder}/{k}")
    first = spark.read.parquet(f"{folder}/0")
    return spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def ran(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if json.loads(p.json).get("stateOperators")]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect(), held


def test_state_follows_active_keys(spark, tmp_path):
    """Ten new keys a batch; those of earlier batches are forgotten, and one that comes back in time is not."""
    batches = [[(f"k{b}-{k}", 1, (100 + b * 10) * SECOND + k, float(90)) for k in range(10)] + [("steady", b, (100 + b * 10) * SECOND + 20, 50.0 if b else 90.0)] for b in range(8)]
    schema = "node_id string, seq long, at long, depth double"
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema)
    rows, held = ran(st.pause_latch(stream, 80, 10, "1 second", 15 * SECOND), str(tmp_path / "run"))
    assert len(rows) == sum(map(len, batches)) and all(r.latched for r in rows)
    assert max(held) <= 45 and held[-1] < 60  # all keys ever: 81
    plain, grown = ran(st.pause_latch(stream, 80, 10), str(tmp_path / "plain"))
    assert len(plain) == len(rows) and grown[-1] > max(held)


def test_late_rows_are_kept(spark, tmp_path):
    batches = [[("a", 0, 100 * SECOND)], [("a", 1, 99 * SECOND), ("a", 2, 50 * SECOND), ("b", 3, 89 * SECOND)], [("c", 4, 300 * SECOND)], [("d", 5, 120 * SECOND)]]
    folder = str(tmp_path / "late")
    stream = stream_of(spark, str(tmp_path / "in"), batches, "node_id string, seq long, at long")
    for _ in range(2):  # started again, it finds nothing new
        q = st.write_late_rows(stream, 10 * SECOND, folder).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert sorted(r.seq for r in spark.read.parquet(f"{folder}/late").collect()) == [2, 3, 5]


class Clock:
    """Timer values and a state handle of a processor that is called by hand."""

    def __init__(self):
        self.now, self.watermark, self.held, self.timers = 0, 0, None, set()

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return min(self.timers)

    def getValueState(self, *_):
        return self

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers = self.timers - {at}

    def registerTimer(self, at):
        self.timers = self.timers | {at}


def processor(fold, **more):
    clock = Clock()
    p = FoldProcessor(fold, ["node_id"], **more)
    p.init(clock)
    return p, clock


def test_a_call_serves_the_keys_of_a_shard():
    """One call, one stored value and one timer for many keys; each has its own state and its own end."""
    p, clock = processor(folds.MembershipFold(100), timers=True, ttl_ms=None)
    rows = pd.DataFrame([("b", 10, 0), ("a", 0, 1), (None, 50, 2), ("a", 150, 3)], columns=["node_id", "at_ms", "seq"])
    out = [tuple(r) for f in p.handleInputRows((7,), iter([rows]), clock) for r in f.itertuples(index=False)]
    assert out == [("a", "added", 0), ("b", "added", 10), (None, "added", 50), ("a", "evicted", 100), ("a", "added", 150)]
    assert clock.timers == {110}
    clock.watermark = 200
    out = [tuple(r) for f in p.handleExpiredTimer((7,), clock, clock) for r in f.itertuples(index=False)]
    assert out == [("b", "evicted", 110), (None, "evicted", 150)] and clock.timers == {250}
    clock.watermark = 250
    out = [tuple(r) for f in p.handleExpiredTimer((7,), clock, clock) for r in f.itertuples(index=False)]
    assert out == [("a", "evicted", 250)] and clock.held is None and not clock.timers


def test_time_to_live_is_each_keys_own():
    p, clock = processor(folds.ReplayFold(), timers=False, ttl_ms=100)
    ask = lambda key, seq: [r[-1] for f in p.handleInputRows((0,), iter([pd.DataFrame([(key, 0, seq)], columns=["node_id", "arrival", "seq"])]), clock) for r in f.itertuples(index=False)]
    assert ask("a", 5) == [True]
    clock.now = 60
    assert ask("b", 5) == [True] and ask("b", 5) == [False]
    clock.now = 120  # the value was stored 60 ago, the state of "a" 120 ago
    assert ask("a", 5) == [True] and ask("b", 5) == [False]


def test_state_of_many_keys_is_few_values(spark, tmp_path):
    """Calls and stored values follow the shards; keys that are numbers come back as numbers."""
    rows = [[(k, 1, 1000 + k, 90.0) for k in range(4000)] + [(None, 1, 1000, 90.0)], [(k, 2, 9000 + k, 50.0) for k in range(4000)] + [(None, 2, 9000, 5.0)]]
    stream = stream_of(spark, str(tmp_path / "in"), rows, "node_id long, seq long, at long, depth double")
    out, held = ran(st.pause_latch(stream, 80, 10), str(tmp_path / "run"))
    assert len(out) == 8002 and max(held) <= SHARDS
    assert {(r.node_id, r.latched) for r in out if r.seq == 2} == {(k, True) for k in range(4000)} | {(None, False)}
