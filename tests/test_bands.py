"""Bands of dominated nodes against the ranking of every node for every demand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import placement

NODE = "capability string, node_id string, cpu_cores int, ram_total_mb long, ram_used_mb long, has_gpu boolean, gpu_total_mb long, gpu_used_mb long, cpu_busy_pct int, cpu_pinned_count int, reported_inflight long, assigned_inflight long, paused boolean, on_battery boolean"
TASK = "id string, issued_at timestamp, capability string, cpu_class string, memory_mb long, gpu_required boolean, gpu_memory_mb long"


@pytest.mark.parametrize("cuts", [(32, 8), (3, 2), (1, 1)])
def test_bands_hold_every_near_best_node(spark, cuts):
    r = random.Random(4)
    nodes = [
        (f"c{k % 2}", f"n{k:03}", r.randrange(9), r.choice([0, 8_000, 64_000]), r.randrange(6_000), r.random() < 0.5, r.choice([0, 8_000]), r.randrange(5_000), r.randrange(101), r.randrange(4), r.randrange(5), r.randrange(5), r.random() < 0.1, r.random() < 0.2)
        for k in range(80)
    ]
    tasks = [(f"t{k:03}", None, r.choice(["c0", "c1", "c2", None]), r.choice(["light", "heavy", "pinned", None]), r.choice([None, r.randrange(70_000), 256]), r.random() < 0.4, r.choice([None, r.randrange(9_000)])) for k in range(200)]
    n, t = spark.createDataFrame(nodes, NODE), spark.createDataFrame(tasks, TASK).withColumn("issued_at", F.lit("2024-01-01").cast("timestamp"))
    every = placement.rank_candidates(t, n)
    best = every.groupBy("demand_id").agg(F.max("score").alias("best"))
    want = {(x.demand_id, x.node_id, x.score) for x in every.join(best, "demand_id").where("score >= best * 0.99").collect()}
    bands = placement.candidate_bands(t, n, cuts=cuts)
    assert {(x.demand_id, x.node_id, x.score) for x in bands.collect()} == want and len(want) > 50
    if cuts == (3, 2):
        picked = lambda ranked, rows: sorted(map(tuple, placement.pick_candidate(t, ranked, chunk_rows=rows).collect()))
        assert picked(bands, 7) == picked(every, 65_536) and len(picked(every, 5)) > 30
