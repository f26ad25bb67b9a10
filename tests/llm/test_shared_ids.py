"""Vectors whose rows share ids, against plain pairs of ids."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from fleetlens.llm import subspace_join

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows):
    links = {i: set() for i, *_ in rows}
    for (i, v, a), (j, w, b) in itertools.combinations(rows, 2):
        if a == b and i != j and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
            links[i].add(j), links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out[i] = (len(links[i]), min(seen))
    return out


def result(spark, rows):
    got = subspace_join.linked_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(x.kept == (x.vec_id == x.component_id) for x in got)
    return {x.vec_id: (x.n_links, x.component_id) for x in got}


def test_an_id_with_two_vectors_has_the_links_of_both(spark):
    r = np.random.default_rng(1)
    a, b = r.standard_normal((2, 16))
    near = lambda v: (v + 0.01 * r.standard_normal(16)).tolist()
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 1), (6, near(a), 1), (7, near(b), 1)]
    assert result(spark, rows) == {5: (2, 5), 6: (1, 5), 7: (1, 5)}
    rows = [(8, a.tolist(), 1), (8, a.tolist(), 1), (9, b.tolist(), 1)]
    assert result(spark, rows) == {8: (0, 8), 9: (0, 9)}
    rows = [(8, a.tolist(), 1), (8, a.tolist(), 1), (9, a.tolist(), 1), (3, a.tolist(), 2), (9, near(a), 1)]
    assert result(spark, rows) == {8: (1, 8), 9: (1, 8), 3: (0, 3)}
    zero = [0.0, *a[1:].tolist()]
    assert result(spark, [(1, zero, 1), (2, [-0.0, *zero[1:]], 1)]) == {1: (1, 1), 2: (1, 1)}


@pytest.mark.parametrize("seed,chunk", [(2, 1024), (3, 5)])
def test_shared_ids_by_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(subspace_join, "CHUNK", chunk)
    r = np.random.default_rng(seed)
    centres = r.standard_normal((9, 16))
    vectors = [(centres[r.integers(9)] + 0.06 * r.standard_normal(16)).tolist() for _ in range(70)]
    rows = [(int(r.integers(60)), vectors[r.integers(70)], int(r.integers(2))) for _ in range(120)]
    assert result(spark, rows) == expected(rows)
