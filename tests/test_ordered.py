"""Skew-safe scans and windows equal their plain definitions, also when one key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.operators import first_record as fr
from fleetlens.operators.ordered import LastKnown, Previous, RunningMax, RunningSum, ordered_scan, seq_bucket, top_k


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", i, rnd.choice([None, *range(9)])) for i in range(3000)]
    return spark.createDataFrame(data, "k string, s long, v int").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_scan_equals_window(rows, size):
    got = ordered_scan(
        rows,
        ["k"],
        ["s"],
        [Previous("prev", F.col("v")), RunningSum("total", F.col("v")), RunningMax("top", F.col("v")), LastKnown("last", F.col("v"))],
        seq_bucket("s", size),
    )
    w = W.partitionBy("k").orderBy("s")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = rows.select(
        "*",
        F.lag("v").over(w).alias("prev"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"),
        F.max("v").over(before).alias("top"),
        F.last("v", ignorenulls=True).over(upto).alias("last"),
    )
    assert sorted(got.collect(), key=lambda r: r.s) == sorted(want.collect(), key=lambda r: r.s)


def test_top_k_beyond_the_map_side_limit(spark):
    df = spark.range(6000).select(F.lit("a").alias("k"), F.col("id").alias("x"), F.array(F.col("id")).alias("y"))
    got = top_k(df, ["k"], [F.desc("x")], 1500)
    assert [r.x for r in got.orderBy("rank").collect()] == list(range(5999, 4499, -1))


def test_top_k_is_cut_before_the_shuffle(rows):
    plan = top_k(rows, ["k"], [F.asc("s")], 3)._jdf.queryExecution().executedPlan().toString()
    assert re_partial(plan)


def re_partial(plan: str) -> bool:
    lines = plan.splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    return any("WindowGroupLimit" in line and "Partial" in line for line in lines[exchange:])


def brute(times, window, cap=None):
    out, start, first = [], None, None
    for i, t in enumerate(times):
        if start is None or t >= start + window or (cap and i - first >= cap):
            start, first = t, i
        out.append((start, first + 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_record_windows(spark, seed):
    rnd = random.Random(seed)
    gap = [3, 40, 400, 9][seed]
    data, expected = [], []
    for key in ("hot", "cold"):
        t, times = 10_000, []
        for _ in range(600 if key == "hot" else 40):
            t += rnd.randrange(gap)
            times.append(t)
        data += [(key, t, i) for i, t in enumerate(times)]
        expected += [(key, i, s) for i, (s, _) in enumerate(brute(times, 100))]
    df = spark.createDataFrame(data, "k string, at_ms long, i int").repartition(3)
    got = fr.first_record_windows(df, ["k"], 100, chunk_windows=2)
    assert sorted((r.k, r.i, r.window_start_ms) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("gap,cap", [(2, 5), (30, 4), (1, 65)])
def test_coalesce_requests(spark, gap, cap):
    rnd = random.Random(gap)
    t, times = 1_000, []
    for _ in range(500):
        t += rnd.randrange(gap + 1)
        times.append(t)
    df = spark.createDataFrame([("f", t, i) for i, t in enumerate(times)], "fingerprint string, at_ms long, request_id long")
    got = fr.coalesce_requests(df, 50, cap, chunk_rows=37)
    want = [(i, s, n) for i, (s, n) in enumerate(brute(times, 50, cap))]
    assert sorted((r.request_id, r.window_start_ms, r.batch_no) for r in got.collect()) == want


def test_stage_percentiles_are_exact(spark):
    """More durations than a sketch of 10,000 entries tells apart, a capability without any and one without a name."""
    from fleetlens.operators.lifecycle import stage_percentiles

    n = 60_000
    hot = spark.range(n).selectExpr("'hot' AS capability", "id * id % 1000003 * 7919 AS queued_ms", "id AS starting_ms", "IF(id < 3, id, NULL) AS running_ms")
    few = spark.createDataFrame([("idle", None, None, None), (None, 5, -2, None), (None, 6, -3, None)], "capability string, queued_ms long, starting_ms long, running_ms long")
    got = {r.capability: r for r in stage_percentiles(hot.unionByName(few)).collect()}
    queued = sorted(k * k % 1000003 * 7919 for k in range(n))
    assert tuple(got["hot"]) == ("hot", n, queued[n // 2 - 1], queued[n * 95 // 100 - 1], n // 2 - 1, n * 95 // 100 - 1, 1, 2)
    assert tuple(got["idle"]) == ("idle", 1, *[None] * 6)
    assert tuple(got[None]) == (None, 2, 5, 6, -3, -2, None, None)
