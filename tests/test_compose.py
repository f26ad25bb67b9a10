"""State machines by composed chunk maps against plain folds over whole keys."""

from __future__ import annotations

import random

import pytest

from fleetlens.operators import first_record as fr
from fleetlens.operators import telemetry as te


def led(ticks, window, penalty):
    standing, out = (None, None, 0), []
    for at in sorted(ticks):
        before = standing[0]
        standing, winner, score = te.next_leader(standing, at, ticks[at], window, penalty)
        out.append((at, winner, score, winner != before))
    return out


@pytest.mark.parametrize("seed,window,chunk", [(1, 40, 7), (2, 500, 5), (3, 15, 1), (4, 90, 1000)])
def test_leaders_over_chunks(spark, seed, window, chunk):
    r = random.Random(seed)
    rows, want = [], []
    for observer, n in (("a", 120), ("b", 30), ("c", 3), (None, 9)):
        ticks = {}
        for k in range(n):
            nodes = r.sample(["n1", "n2", "n3", "n4"] if k % 40 < 30 else ["n5", "n6"], r.choice([1, 2, 2]))
            ticks[k * 10 + r.randrange(9)] = {x: r.randrange(100, 140) for x in nodes}
        rows += [(observer, t, x, s) for t, of in ticks.items() for x, s in of.items()]
        want += [(observer, *x) for x in led(ticks, window, 20)]
    df = spark.createDataFrame(rows, "observer string, tick_ms long, node_id string, score long").repartition(5)
    got = te.leader_with_antiflap(df, window, 20, chunk_rows=chunk).collect()
    key = lambda x: (x[0] is not None, x[0] or "", x[1])
    assert sorted(((x.observer, x.tick_ms, x.leader, x.score, x.changed) for x in got), key=key) == sorted(want, key=key)


def test_leader_maps_compose_like_their_ticks():
    """A map of two chunks equals the map of both, for standings of named and unnamed nodes."""
    r = random.Random(9)
    for _ in range(60):
        ticks = [(k * 10, {x: r.randrange(90, 120) for x in r.sample(["p", "q", "s"] if k < 6 else ["q", "t"], 2)}) for k in range(12)]
        window, cut = r.choice([15, 45, 400]), r.randrange(1, 12)
        both = te._led_both(te._leader_map(ticks[:cut], window, 10), te._leader_map(ticks[cut:], window, 10))
        whole = te._leader_map(ticks, window, 10)
        for leader in (None, "p", "q", "t", "x"):
            for fallen in (None, "p", "q", "t", "y"):
                until = r.randrange(-20, window)
                standing = (leader, fallen, until)
                for at, scores in ticks:
                    standing, _, _ = te.next_leader(standing, at, scores, window, 10)
                entry = {"leader": leader, "fallen": fallen, "until": until}
                for m in (whole, both):
                    out = te._led(m, entry)
                    assert (out["leader"], out["fallen"], out["until"]) == standing


def opened(at, window):
    out, start = {}, None
    for t in sorted(set(at)):
        if start is None or t >= start + window:
            start = t
        out[t] = start
    return out


@pytest.mark.parametrize("chunk", [1, 4, 13, 10_000])
def test_first_record_windows_over_chunks(spark, chunk):
    r = random.Random(chunk)
    # Regular arrivals: chains of windows that never meet.
    times = {"even": list(range(0, 900, 40)), "dense": [r.randrange(2_000) for _ in range(150)], "lone": [5], None: [1, 70, 80, 141]}
    df = spark.createDataFrame([(k, t) for k, at in times.items() for t in at], "k string, at_ms long")
    got = {(x.k, x.at_ms): x.window_start_ms for x in fr.first_record_windows(df.where("k is not null"), ["k"], 60, chunk_rows=chunk).collect()}
    assert got == {(k, t): s for k, at in times.items() if k for t, s in opened(at, 60).items()}


def test_window_maps_of_crowded_chunks():
    """Windows that span several chunks have as many outcomes as rows; maps are composed without comparing all of them with all."""
    import time

    import numpy as np

    n, window = 40_000, 150_000
    at = np.arange(0, 8 * n) * 2 + np.arange(8 * n) % 2
    cut = [at[k * n : (k + 1) * n] for k in range(8)]
    begun = time.process_time()
    maps = [fr._chunk_map(x, x, window, fr._NO_CAP) for x in cut]
    pairs = maps
    while len(pairs) > 1:
        pairs = [fr._followed(x, y) for x, y in zip(pairs[::2], pairs[1::2])]
    assert time.process_time() - begun < 20
    assert len(pairs[0]) <= 2 + 4 * (window // 2 + 2)
    entry = None
    for m in maps:
        entry = fr._passes(m, entry)
    start = int(at[0])
    while (later := at[at >= start + window]).size:
        start = int(later[0])
    assert entry == fr._passes(pairs[0], None) and entry["at"] == start + window


def benches(rows, threshold, bench):
    count, last, trip, out = 0, None, None, []
    for at, ok in rows:
        if trip is not None and (at - last >= bench):
            out.append((trip, last + bench))
            trip, count = None, 0
        elif last is not None and not ok and at - last >= bench and count >= threshold:
            count = 0
        if ok:
            if trip is not None:
                out.append((trip, at))
            count, trip, last = 0, None, None
            continue
        count += 1
        last = at
        if trip is None and count == threshold:
            trip = at
    if trip is not None:
        out.append((trip, last + bench))
    return out


@pytest.mark.parametrize("parts", [1, 3, 256])
def test_breakers_over_chunks_of_parts(spark, parts):
    from datetime import UTC, datetime, timedelta

    r = random.Random(parts)
    zero = datetime(2024, 1, 1, tzinfo=UTC)
    rows, want = [], []
    for node in ("a", "b"):
        at, own = 0, []
        for k in range(200):
            at += r.choice([1, 5, 20, 70, 90])
            own.append((at, r.random() < 0.03))
            rows.append((node, zero + timedelta(seconds=at), f"{node}{k:04}", own[-1][1]))
        want += [(node, *x) for x in benches(own, 3, 60)]
    df = spark.createDataFrame(rows, "node_id string, at timestamp, outcome_id string, ok boolean")
    seconds = lambda t: int((t.replace(tzinfo=UTC) - zero).total_seconds())
    got = te.breaker(df, 3, 60_000, fold_parts=parts).collect()
    whole = te.breaker(df, 3, 60_000, fold_parts=10_000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole)) and len(got) > 10
    assert len({seconds(x.benched_at) for x in got}) > 5 and len(want) > 5
