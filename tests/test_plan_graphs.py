"""Layers and cascades of plans walked in one piece and by rounds, against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from fleetlens.plans import graph


def plans(seed):
    r = random.Random(seed)
    nodes, edges, states = [], [], []
    for p in range(12):
        n = r.choice([1, 2, 5, 9, 30])
        name = f"p{p}"
        nodes += [(name, f"s{k}") for k in range(n)] + [(name, "s0")] * (p % 2)
        for _ in range(r.randrange(2 * n)):
            x, y = sorted((r.randrange(n), r.randrange(n)))
            if p % 4 == 3 or x != y:  # every fourth plan has self edges and cycles
                pair = (x, y) if p % 4 == 3 and r.random() < 0.2 else (y, x)
                edges += [(name, f"s{pair[0]}", f"s{pair[1]}")] * r.choice([1, 1, 2])
        edges += [(name, "s0", "nowhere"), (name, "elsewhere", "s0")] * (p % 3 == 0)
        states += [(name, f"s{k}", r.choice(["waiting", "waiting", "waiting", "done", "failed", "timed_out"])) for k in range(n)]
    nodes += [("chain", f"s{k}") for k in range(26)]
    edges += [("chain", f"s{k}", f"s{k - 1}") for k in range(1, 26)]
    states += [("chain", f"s{k}", "failed" if k == 3 else "done" if k == 20 else "waiting") for k in range(26)]
    return nodes, edges, states


def layers(nodes, edges):
    steps = set(nodes)
    needs = {s: {(p, y) for p, x, y in edges if (p, x) == s and (p, y) in steps} for s in steps}
    out = {}
    while ready := [s for s in steps if s not in out and needs[s] <= set(out)]:
        now = {s: 1 + max((out[d] for d in needs[s]), default=-1) for s in ready}
        out |= now
    return {s: (out.get(s), s not in out) for s in steps}


def cascade(edges, states):
    state = {(p, x): s for p, x, s in states}
    front, hit = {s for s, v in state.items() if v in ("failed", "timed_out")}, set()
    while front:
        front = {(p, x) for p, x, y in edges if (p, y) in front and state.get((p, x)) == "waiting"} - hit
        hit |= front
    return hit


@pytest.mark.parametrize("piece", [graph.PIECE, 20, 0])
def test_layers_and_cascades(spark, piece):
    nodes, edges, states = plans(piece)
    n, e = spark.createDataFrame(nodes, "plan_id string, node_id string"), spark.createDataFrame(edges, "plan_id string, from_id string, to_id string")
    got = graph.topo_layers(n, e, piece=piece).collect()
    assert {(r.plan_id, r.node_id): (r.layer, r.cycle) for r in got} == layers(nodes, edges) and len(got) == len(set(nodes))
    s = spark.createDataFrame(states, "plan_id string, node_id string, state string")
    out = graph.skip_cascade(e, s, piece=piece).collect()
    assert {(r.plan_id, r.node_id) for r in out} == cascade(edges, states) and len(out) == len(set(out))
    assert graph.topo_layers(n.limit(0), e, piece=piece).count() == graph.skip_cascade(e, s.limit(0), piece=piece).count() == 0
    assert {r.layer for r in graph.topo_layers(n, e.limit(0), piece=piece).collect()} == {0}


def test_plans_are_walked_in_bounded_runs():
    """Any number of plans may share an Arrow batch; no more than so many rows are numbered together."""
    kind = pa.list_(pa.struct([("node_id", pa.string()), ("to_id", pa.string()), ("state", pa.string())]))
    lists = [[{"node_id": f"s{k}", "to_id": None, "state": "waiting"} for k in range(n)] for n in [3, 4, 0, 9, 2, 2, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(7)]), pa.array(lists, kind)], ["plan_id", "rows"])
    runs = list(graph._pieces(iter([batch]), together=7))
    assert [r.column("plan_id").to_pylist() for r in runs] == [["p0", "p1", "p2"], ["p3"], ["p4", "p5"], ["p6"]]
    assert sum((r.column("rows").to_pylist() for r in runs), []) == lists
    assert list(graph._pieces(iter([batch.slice(0, 0)]))) == []
