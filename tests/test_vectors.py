"""Vector lookup over a grid of blocks against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest

from fleetlens.operators import search


@pytest.mark.parametrize("query_block,vector_block,merged", [(512, 1 << 16, 256), (3, 20, 256), (4, 7, 5)])
def test_lookup_over_blocks(spark, monkeypatch, query_block, vector_block, merged):
    monkeypatch.setattr(search, "MERGED_BLOCKS", merged)
    r = np.random.default_rng(3)
    v, q = r.standard_normal((150, 8)).round(3), r.standard_normal((11, 8)).round(3)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(500, v[7].tolist()), (501, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{k}", x.tolist()) for k, x in enumerate(q)] + [("none", None)], "query_id string, embedding array<double>")
    found = search.embed_lookup(vectors, queries, 4, query_block, vector_block)
    got = {(x.query_id, x["rank"]): (x.vec_id, round(x.score, 9)) for x in found.collect()}
    want = {}
    for k, x in enumerate(q):
        ranked = sorted((-round(float(np.dot(x, y)), 9), i) for i, y in rows if y is not None)[:4]
        want |= {(f"q{k}", n + 1): (i, -s) for n, (s, i) in enumerate(ranked)}
    assert got == want
    assert search.embed_lookup(vectors.limit(0), queries, 4).count() == search.embed_lookup(vectors, queries.limit(0), 4).count() == 0
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
