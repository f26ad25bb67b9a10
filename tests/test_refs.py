"""References of steps: odd pointers and ids, many references in one step, work done once."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import q_plans
from fleetlens.plans import refs


def _resolved(spark, inputs: dict[str, str], outputs: dict[str, str]) -> dict:
    n = spark.createDataFrame([("p", k, v) for k, v in inputs.items()], "plan_id string, node_id string, input string")
    o = spark.createDataFrame([("p", k, v) for k, v in outputs.items()], "plan_id string, node_id string, output string")
    return {r.node_id: (r.resolved_input, r.reason) for r in refs.resolve_refs(n, o).collect()}


def _ref(task: str, pointer: str | None = None) -> str:
    return json.dumps({"$task_output": task} | ({} if pointer is None else {"pointer": pointer}), separators=(",", ":"))


def test_ids_and_pointers_of_any_text(spark):
    long = "x" * 50_000
    inputs = {
        "long": _ref(long),
        "quote": _ref("it's", "/it's"),
        "escaped": _ref('a"b\\', '/k"'),
        "index": _ref("it's", "/99999999999"),
        "blank": _ref("it's", ""),
        "suffix": '{"x\\"$task_output":1}',
        "no json": "{",
    }
    got = _resolved(spark, inputs, {long: "1", "it's": '{"it\'s":2}', 'a"b\\': '{"k\\"":3}'})
    assert got == {
        "long": ("1", None),
        "quote": ("2", None),
        "escaped": ("3", None),
        "index": (None, "pointer_miss"),
        "blank": ('{"it\'s":2}', None),
        "suffix": ('{"x\\"$task_output":1}', None),
        "no json": (None, None),
    }


@pytest.mark.parametrize("filler", ["", "y" * refs.WALKED])
def test_pointers_into_small_and_large_outputs(spark, filler):
    output = json.dumps({"a": [{"k": None, "0": "z"}, [1.50, "s"]], "7": {"n/m": {"~": True}}, " b": 4, "c?": 5, "w": filler})
    pointers = ["/a/0/k", "/a/0/0", "/a/1/0", "/a/2", "/a/k", "/7", "/7/n~1m/~0", "/a//1/1", "/w/0", "/ b", "/b", "/c?", "/it's", "/a/99999999999"]
    got = _resolved(spark, {p: _ref("o", p) for p in pointers}, {"o": output})
    hits = {
        "/a/0/k": "null",
        "/a/1/0": "1.5",
        "/7": '{"n/m":{"~":true}}',
        "/7/n~1m/~0": "true",
        "/a//1/1": '"s"',
        "/ b": "4",
        "/c?": "5",
    }
    assert got == {p: (hits[p], None) if p in hits else (None, "pointer_miss") for p in pointers}


def test_many_references_keep_their_order(spark):
    many = 5 * refs.GATHERED + 3
    outputs = {f"t{i}": str(i) for i in range(many)}
    inputs = {"all": "[" + ",".join(_ref(k) for k in outputs) + "]", "lost": "[" + ",".join([*map(_ref, outputs), _ref("t"), _ref("t0", "/x")]) + "]"}
    got = _resolved(spark, inputs, outputs)
    assert got["all"] == ("[" + ",".join(outputs.values()) + "]", None)
    # The first reason counts.
    assert got["lost"] == (None, "unknown_task")


def test_a_text_travels_with_its_first_reference(spark, tmp_path):
    filler, many = "q" * 1000, 200
    n = spark.createDataFrame([("p", "a", json.dumps({"f": filler, "r": [json.loads(_ref("o"))] * many}))], "plan_id string, node_id string, input string")
    o = spark.createDataFrame([("p", "o", "1")], "plan_id string, node_id string, output string")
    seen = []
    real = refs._firsts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(refs, "_firsts", lambda rows, *a: real((seen.append(rows), rows)[1], *a))
        assert refs.resolve_refs(n, o).head().reason is None
    assert seen[0].agg(F.count("text"), F.count("*")).head() == (1, many)


def test_steps_are_grouped_once(spark, sf):
    plan = q_plans.resolve_refs_c13(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" not in plan and "p_partkey" not in plan
