"""Verified ranges of a chain against a walk in plain Python, with breaks, forks and markers."""

from __future__ import annotations

import random

from fleetlens.catalog import bindings as b
from fleetlens.operators import audit as au
from fleetlens.operators import pins as pn
from fleetlens.session import written

def test_segments_equal_a_walk(spark):
    rng = random.Random(3)
    entries = []
    for node in "abc":
        before = "start"
        for seq in range(1, 200):
            if rng.random() < 0.05:
                before = f"{node}{seq}"
                continue  # a row that is missing
            for copy in range(2 if rng.random() < 0.05 else 1):  # now and then a fork
                prev = "other" if rng.random() < 0.05 else before
                entries.append((node, seq, prev, f"{node}{seq}" + "x" * copy, rng.random() > 0.05))
            before = f"{node}{seq}"
    want = {}
    for node in "abc":
        last = opened = None
        for _, seq, prev, own, sound in sorted((x for x in entries if x[0] == node), key=lambda x: (x[1], x[3])):
            linked = last is not None and last == (seq - 1, prev)
            opened = seq + 1 if not sound else opened if linked else seq
            want[node, seq, own] = opened
            last = (seq, own)
    table = spark.createDataFrame(entries, "node_id string, seq long, prev_hash string, entry_hash string, sound boolean")
    breaks = au.chain_breaks(table)
    points = table.select("node_id", "seq", "entry_hash", "sound")
    got = {(r.node_id, r.seq, r.entry_hash): r.segment_start for r in au.segment_starts(points, breaks).collect()}
    assert got == want
    some = points.filter("seq % 7 = 0")
    got = au.segment_starts(some, breaks).collect()
    assert {(r.node_id, r.seq, r.entry_hash): r.segment_start for r in got} == {k: v for k, v in want.items() if k[1] % 7 == 0}
    assert au.segment_starts(points.limit(0), breaks).count() == 0 == au.chain_breaks(table.limit(0)).count()


def test_corroborate_reads_the_chain_once(spark, sf, tmp_path):
    b.chained(spark, sf).write.parquet(str(tmp_path / "chain"))
    pins, runs = written(b.pins(spark, sf), "pins"), written(b.runs(spark, sf), "runs")
    out = pn.corroborate(pins, spark.read.parquet(str(tmp_path / "chain")), runs)
    # What is left to read are the entries that the one pass wrote, without details and subjects.
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    want = pn.corroborate(b.pins(spark, sf), b.chained(spark, sf), b.runs(spark, sf))
    assert sorted(out.collect()) == sorted(want.collect())


def test_short_chains_are_ordered_in_one_piece(spark, monkeypatch):
    rows = [(n, seq, f"{n}{seq - 1}", f"{n}{seq}", seq % 11 > 0) for n in "ab" for seq in range(1, 150) if seq % 17]
    table = spark.createDataFrame(rows, "node_id string, seq long, prev_hash string, entry_hash string, sound boolean")
    points = table.select("node_id", "seq", "entry_hash")
    got = {}
    for most in (20, 65_536):
        monkeypatch.setattr(au, "NODE_ENTRIES", most)
        breaks = au.chain_breaks(table)
        assert ("Join" in breaks._jdf.queryExecution().optimizedPlan().toString()) == (most == 20)
        got[most] = sorted(au.segment_starts(points, breaks, table).collect())
    assert got[20] == got[65_536] and len(got[20]) == len(rows)


def test_a_stored_chain_is_hashed_once(spark, sf):
    stored = b.stored_chain(spark, sf)
    assert "sha2(" not in stored._jdf.queryExecution().optimizedPlan().toString()
    chain = b.chain(spark, sf)
    assert sorted(stored.select(chain.columns).collect(), key=str) == sorted(chain.collect(), key=str)
