"""Vectors meet by group: what travels follows the table and not the square of a label."""

from __future__ import annotations

import numpy as np
import pytest
from test_shared_ids import SCHEMA, expected, result

from fleetlens.llm import subspace_join


def shuffled(spark) -> int:
    """Bytes that stages have written for others so far."""
    store, total = spark.sparkContext._jsc.sc().statusStore(), 0
    for jobs in [store.jobsList(None)]:
        stages = {s for k in range(jobs.size()) for s in map(int, str(jobs.apply(k).stageIds().mkString(",")).split(",")) if s >= 0}
    for stage in stages:
        try:
            total += store.lastStageAttempt(stage).shuffleWriteBytes()
        except Exception:  # forgotten by now
            continue
    return total


def test_what_travels_follows_the_table(spark, tmp_path):
    r = np.random.default_rng(7)
    n = 4000
    unit = r.standard_normal((n, 64))
    rows = [(k, v.tolist(), 1) for k, v in enumerate(unit / np.linalg.norm(unit, axis=1)[:, None])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "v"))
    before = shuffled(spark)
    got = subspace_join.linked_vectors(spark.read.parquet(str(tmp_path / "v")))
    assert {(x.n_links, x.kept) for x in got.collect()} == {(0, True)}
    assert 0 < shuffled(spark) - before < 4 * n * 64 * 4


@pytest.mark.parametrize("spread", [0.125, 0.04, 0.02])
def test_ties_by_brute_force(monkeypatch, spread):
    monkeypatch.setattr(subspace_join, "SQUARE", 16)
    r = np.random.default_rng(3)
    x = spread * r.standard_normal((1500, 16))
    x[:400] = x[0] + 0.02 * r.standard_normal((400, 16))
    x[400:600] = x[400] + 0.03 * r.standard_normal((200, 16))
    points = np.rint(x * subspace_join.STEPS).astype(np.int16)
    reach = 0.1 * subspace_join.STEPS
    wide = points.astype(np.float64)
    near = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(axis=2) <= reach * reach
    ties = subspace_join.Ties(len(x))
    ties.tie(*np.nonzero(near))
    assert (subspace_join._tied(points, reach, reach * reach) == ties.roots(np.arange(len(x)))).all()


def test_parts_of_large_labels_and_groups(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "CELL", 9)
    monkeypatch.setattr(subspace_join, "CHUNK", 3)
    r = np.random.default_rng(8)
    centres = r.standard_normal((5, 16))
    rows = [(k, (centres[k % 5] + 0.08 * r.standard_normal(16)).tolist(), int(k % 7 == 0)) for k in range(90)]
    rows += [(k + 100, rows[k][1], rows[k][2]) for k in range(0, 90, 9)]
    assert result(spark, rows) == expected(rows)


def test_floats_and_doubles_alike(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((3, 8)).astype(np.float32)
    rows = [(k, (base[k % 3] + 0.05 * r.standard_normal(8).astype(np.float32)).tolist(), 1) for k in range(40)]
    floats = subspace_join.linked_vectors(spark.createDataFrame(rows, SCHEMA.replace("double", "float"))).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in floats} == result(spark, rows) == expected(rows)


def test_tables_that_grow_are_not_broadcast(spark):
    r = np.random.default_rng(10)
    rows = [(k, r.standard_normal(8).tolist(), 1) for k in range(20)]
    out = subspace_join.linked_vectors(spark.createDataFrame(rows, SCHEMA))
    assert len(out.collect()) == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert [line.split("Join")[0].split()[-1] for line in plan.split("\n") if "Join" in line][0] == "SortMerge"
