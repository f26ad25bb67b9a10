"""Registered queries against their SQL, held-out accuracy, and the pipeline against plain Python stages."""

from __future__ import annotations

import itertools
import re

import pytest

import corpus_pipeline
from check_oracles import compare, connect
from fleetlens.llm.common import stored, table
from fleetlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf, name):
    ok, note = compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])
    assert ok and "types" not in note, note


@pytest.mark.parametrize("name", ["op2_line_templates", "op9_link_trust"])
def test_native_plans_hold_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_by_brute_force(spark, sf):
    sets = {r.doc_id: shingles(r.text, 3) for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op8_minhash_forest"](spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets, 85)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table holds out 19 labels only
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = [r for r in QUERIES["op1_quality_ftrl"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.9 * len(got) > 0


def test_held_out_language(spark, sf):
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = [r for r in QUERIES["op10_segmentation_langid"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.97 * len(got) > 0


def test_packing_query_covers_every_document(spark, sf):
    got = QUERIES["op6_length_buckets"](spark, sf).groupBy("doc_id").sum("length").collect()
    want = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table(spark, sf, "documents").collect()}
    assert {r.doc_id: r["sum(length)"] for r in got} == want


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), "stage")
        kept[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = kept["quality classifier"]
    ids = {r.doc_id for r in after}
    wrong = [i for i, q in truth.items() if (i in ids) != bool(q)]
    assert len(wrong) <= 0.05 * len(truth)
    before, after = kept["line dedup"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = kept["near-duplicates"]
    parts = components({r.doc_id: shingles(r.text, 5) for r in before}, 80)
    assert {r.doc_id for r in after} == {i for i, c in parts.items() if i == c}
    before, after = kept["benchmark decontamination"]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bad = {tuple(w[k : k + min(10, len(w))]) for w in (norm(r.text) for r in table(spark, sf, "benchmark").collect()) if w for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(b) for b in bad}
    hit = lambda w: any(tuple(w[k : k + n]) in bad for n in sizes for k in range(len(w) - n + 1))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not hit(norm(r.text))}
    before, after = kept["packing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_pipeline_leaves_one_row_of_each_group_of_copies(spark, sf):
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    text = lambda of: [" ".join(word(of * 9_000 + k * 30 + i) for i in range(12)) for k in range(40)]
    footer = "All rights to this footer line stay with us"
    rows = [(100 + k, "\n".join([*text(1), footer])) for k in range(12)]
    rows += [(200 + k, "\n".join([*text(2)[:k], f"an edited line {'abcdefgh'[k]} of this one copy", *text(2)[k + 1 :], footer])) for k in range(8)]
    rows += [(300 + k, "\n".join([*text(3 + k), footer])) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, sf), "stage")
        if name == "near-duplicates":
            left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {100, 200, *range(300, 306)}
    assert left[100] == rows[0][1] and left[200] == rows[12][1].removesuffix(f"\n{footer}")
    assert {k: left[k] for k in range(300, 306)} == {300 + k: "\n".join(text(3 + k)) for k in range(6)}
    assert {r.doc_id for r in docs.collect()} == set(left) and all(r.length for r in docs.collect())
