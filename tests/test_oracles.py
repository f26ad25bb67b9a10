"""Every registered query against its SQL, and the shape of every plan."""

from __future__ import annotations

import re

import pytest

from check_oracles import compare, connect
from fleetlens.catalog import load

QUERIES, ORACLES = load()
# Joining a one-row result, or a handful of request kinds, needs no key to spread.
NESTED_LOOP = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin")


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not NESTED_LOOP.search(plan), "every join must have a key"
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan), "a window without a key"
    if name in ORACLES:
        ok, note = compare(df, con, ORACLES[name])
        assert ok, note
        assert "types" not in note, note
    else:
        assert df.columns
        assert df.count() > 0


def test_no_query_without_oracle_by_accident():
    assert set(QUERIES) == set(ORACLES)
