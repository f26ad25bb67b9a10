"""The stored positional index: pruning, refreshes against rebuilds, tombstones, merges and interrupted refreshes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import positional, search

TEXTS = {
    "a": "The quick brown fox. The QUICK brown dog",
    "b": "no no no, maybe no",
    "c": "",
    "d": "nut\x00 the quick",
    "e": "ünïcode word the quick brown",
    "f": None,
}


def docs(spark, texts, scope="s"):
    rows = [(scope, p, t) for p, t in texts.items()]
    return spark.createDataFrame(rows, "scope string, path string, content string").withColumn("version", F.sha2(F.coalesce("content", F.lit("")), 256))


def positions(index):
    return sorted((r.scope, r.path, r.term, r.tf, r.dl, tuple(r.positions)) for r in index.postings.collect())


def wanted(texts, scope="s"):
    out = []
    for path, text in texts.items():
        words = re.findall(r"[^\W_]+", (text or "").lower()) if "\x00" not in (text or "") else []
        for term in set(words):
            at = tuple(k for k, w in enumerate(words) if w == term)
            out.append((scope, path, term, len(at), len(words), at))
    return sorted(out)


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / "index")


def test_refresh_equals_rebuild_and_only_changes_are_written(spark, folder):
    positional.refresh(docs(spark, TEXTS), folder, buckets=4)
    assert positions(positional.open_index(spark, folder)) == wanted(TEXTS)
    later = {k: t for k, t in TEXTS.items() if k != "a"} | {"b": "yes", "g": "new words words"}
    state = positional.refresh(docs(spark, later), folder)
    assert state == (0, 1, 4)
    index = positional.open_index(spark, folder)
    assert positions(index) == wanted(later)
    added = spark.read.parquet(f"{folder}/postings/segment=1")
    assert {r.path for r in added.select("path").distinct().collect()} == {"b", "g"}
    assert {r.path for r in spark.read.parquet(f"{folder}/removed/segment=1").collect()} == {"a", "b"}
    # The statistics of a rebuild, though no unchanged text was read.
    fresh = search.build_index(docs(spark, later)).corpus.first()
    kept = index.corpus.first()
    assert (kept.n_docs, round(kept.avgdl, 9)) == (fresh.n_docs, round(fresh.avgdl, 9))
    # Nothing changes: an empty segment.
    assert positional.refresh(docs(spark, later), folder).last == 2 and positions(positional.open_index(spark, folder)) == wanted(later)
    merged = positional.merge_segments(spark, folder)
    assert merged == (3, 3, 4) and positions(positional.open_index(spark, folder)) == wanted(later)
    assert positional.open_index(spark, folder).corpus.first() == kept
    last = {"b": "again other", "z": "zebra"}
    positional.refresh(docs(spark, last), folder)
    assert positions(positional.open_index(spark, folder)) == wanted(last)
    positional.refresh(docs(spark, last | {"y": "more"}), folder, listing_truncated=True)
    positional.refresh(docs(spark, {}), folder, listing_truncated=True)
    assert positions(positional.open_index(spark, folder)) == wanted(last | {"y": "more"})
    positional.refresh(docs(spark, {}), folder)
    assert positions(positional.open_index(spark, folder)) == [] and positional.open_index(spark, folder).corpus.count() == 0


def test_a_segment_counts_once_it_is_committed(spark, folder):
    positional.refresh(docs(spark, TEXTS), folder)
    # A refresh that died before its commit has left part of its tables.
    docs(spark, {"x": "half done"}).select("scope", "path").write.parquet(f"{folder}/removed/segment=1")
    positional._write_postings(positional.positional_postings(docs(spark, {"x": "half done"})), folder, 1, 64)
    assert positions(positional.open_index(spark, folder)) == wanted(TEXTS)
    positional.refresh(docs(spark, TEXTS | {"g": "whole"}), folder)
    assert positions(positional.open_index(spark, folder)) == wanted(TEXTS | {"g": "whole"})


@pytest.fixture()
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_searches_read_the_buckets_of_their_terms(spark, folder, tmp_path, whole_plans):
    positional.refresh(docs(spark, TEXTS), folder, buckets=16)
    index = positional.open_index(spark, folder)
    for found in (search.search(index, ["quick"], limit=None), positional.search_phrase_index(index, "quick brown", limit=None)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
        assert any("bucket" in f and "segment" in f for f in filters), filters
        assert "content" not in plan
    search.write_index(search.build_index(docs(spark, TEXTS)), str(tmp_path / "plain"), buckets=16)
    plain = search.search(search.read_index(spark, str(tmp_path / "plain")), ["quick"], limit=None)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plain._jdf.queryExecution().executedPlan().toString())
    assert sorted(r.path for r in plain.collect()) == ["a", "e"]


def test_phrases_by_positions(spark, folder):
    positional.refresh(docs(spark, TEXTS), folder)
    index = positional.open_index(spark, folder)
    hits = lambda phrase: sorted((r.path, r.occurrences) for r in positional.search_phrase_index(index, phrase).collect())
    assert hits("the QUICK-brown") == [("a", 2), ("e", 1)]
    assert hits("no no") == [("b", 2)] and hits("no no no") == [("b", 1)] and hits("brown quick") == [] and hits("absent") == []
    with pytest.raises(ValueError):
        positional.search_phrase_index(index, " .. ")
    plain = {r.path: (r.occurrences, round(r.score, 9)) for r in search.search_phrase(docs(spark, TEXTS), "the quick").collect()}
    assert plain == {r.path: (r.occurrences, round(r.score, 9)) for r in positional.search_phrase_index(index, "the quick").collect()}


def test_failures_beside_results(spark):
    results = spark.createDataFrame([("a", "s1", "x"), ("a", "s1", "y"), ("a", "s2", "z"), ("b", "s3", "w"), ("c", "s9", "v")], "node_id string, scope string, path string")
    targets = spark.createDataFrame([("a", "s1", 2), ("a", "s2", 2), ("b", "s3", 2), ("b", "s4", 2)], "node_id string, scope string, truncated_targets long")
    answers = spark.createDataFrame([("a", "s1", None), ("a", "s2", None), ("a", "s2", "broken"), ("b", "s3", None), ("c", "s9", None)], "node_id string, scope string, error string")
    rows = search.with_provenance(results, targets, answers).collect()
    of = lambda kind, *names: sorted(tuple(r[n] for n in names) for r in rows if r.kind == kind)
    assert of("result", "node_id", "scope", "path") == [("a", "s1", "x"), ("a", "s1", "y"), ("b", "s3", "w")]
    assert of("failure", "node_id", "scope", "error") == [("a", "s2", "broken"), ("b", "s4", "no answer")]
    assert of("provenance", "targets_ok", "targets_failed", "truncated_targets") == [(2, 2, 2)]
    none = search.with_provenance(results, targets.limit(0), answers).collect()
    assert [(r.kind, r.targets_ok, r.targets_failed, r.truncated_targets) for r in none] == [("provenance", 0, 0, 0)]


def test_postings_are_made_once(spark, tmp_path):
    """Dealing postings to their writers does not make them a second time."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [("s", f"d{k}", "the", 1, 1, [0]) for k in range(200)]
    postings = spark.createDataFrame(rows, "scope string, path string, term string, tf long, dl long, positions array<int>")
    positional._write_postings(postings.mapInPandas(count, postings.schema), str(tmp_path), 0, 4)
    assert made.value == 200
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 200


def test_a_fresh_index_counts_words_where_they_are(spark):
    one = docs(spark, {"a": "The the of", "b": ""})
    postings = search.build_index(one).postings
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in postings.select("path", "dl", "term", "tf").collect()) == [("a", 3, "of", 1), ("a", 3, "the", 2)]
    # Rows of one path and length are one document, as ever.
    twice = search.build_index(one.unionByName(docs(spark, {"a": "of of x"}))).postings.filter("path = 'a'")
    assert sorted(tuple(r) for r in twice.select("term", "tf").collect()) == [("of", 3), ("the", 2), ("x", 1)]


@pytest.mark.parametrize("prefix", [False, True])
def test_a_search_cuts_texts_once(spark, prefix):
    index = search.build_index(docs(spark, {"a": "than thanks x", "b": "thank than", "c": "x thanks", "d": "other"}))
    hits = search.search(index, ["than"], not_terms=["x"], prefix=prefix, limit=None)
    assert "split(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    plain = search.search(index._replace(sized=None), ["than"], not_terms=["x"], prefix=prefix, limit=None)
    assert sorted(hits.collect()) == sorted(plain.collect()) and [r.path for r in hits.collect()] == ["b"]


def test_a_refresh_asks_for_its_documents_twice(spark, folder):
    """Once for their versions and once for the texts of new ones, however many tables it writes."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    first = docs(spark, TEXTS)
    positional.refresh(first.mapInPandas(count, first.schema), folder, buckets=4)
    assert made.value == 2 * len(TEXTS)
    assert positions(positional.open_index(spark, folder)) == wanted(TEXTS)
    later = docs(spark, TEXTS | {"b": "yes"})
    positional.refresh(later.mapInPandas(count, later.schema), folder)
    assert made.value == 4 * len(TEXTS)
    assert positions(positional.open_index(spark, folder)) == wanted(TEXTS | {"b": "yes"})
    # Rows of one document: the greatest version holds, rows without a version or a path are not listed.
    rows = [("s", "b", "older", "1"), ("s", "b", "newer words", "2"), ("s", "b", "newer words", "2"), ("s", "x", "none", None), ("s", None, "none", "1")]
    twice = spark.createDataFrame(rows, "scope string, path string, content string, version string")
    positional.refresh(twice, folder + "-twice", buckets=4)
    assert positions(positional.open_index(spark, folder + "-twice")) == wanted({"b": "newer words"})


def test_words_are_grouped_in_runs_of_bounded_length(monkeypatch):
    monkeypatch.setattr(positional, "WORDS", 5)
    monkeypatch.setattr(positional, "ROWS", 2)
    texts = [["a", "b", "a"], [], ["c"], ["b", "b", "b", "a", "d", "a", "b"], ["a"], []]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"scope": ["s"] * 6, "path": [f"p{k}" for k in range(6)], "words": pa.array(texts, pa.list_(pa.string()))})
    out = [r for b in positional._grouped(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    got = sorted((r["path"], r["term"], r["tf"], r["dl"], tuple(r["positions"])) for r in out)
    assert got == sorted((f"p{k}", w, t.count(w), len(t), tuple(i for i, x in enumerate(t) if x == w)) for k, t in enumerate(texts) for w in set(t))
