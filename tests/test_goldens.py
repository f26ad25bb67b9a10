"""Cases with known answers."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.functions import text, timefn
from fleetlens.operators import audit as au
from fleetlens.operators import corpus, costs, lifecycle, merge, pins, placement, rules, search, telemetry
from fleetlens.operators import first_record as fr
from fleetlens.plans import checkpoints as cp
from fleetlens.plans import graph, refs, summary
from fleetlens.vocab import ZERO_HASH


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- merging -------------------------------------------------------------------------------------------------


def contributions(spark, *outputs, status="ok"):
    data = [("r", f"n{i}", status, 1, o, None) for i, o in enumerate(outputs, 1)]
    return spark.createDataFrame(data, "request_id string, node_id string, status string, duration_ms long, output string, error string")


def test_concat_keeps_node_order(spark):
    c = contributions(spark, '{"items":[{"v":"a1"},{"v":"a2"}]}', '[{"v":"b1"}]', '"opaque"')
    got = merge.merge_concat(c).orderBy("item_no").select("node_id", F.to_json("item").alias("i")).collect()
    assert [tuple(r) for r in got] == [("n1", '{"v":"a1"}'), ("n1", '{"v":"a2"}'), ("n2", '{"v":"b1"}'), ("n3", '"opaque"')]
    assert rows(merge.provenance(c), "node_id", "item_count") == [("n1", 2), ("n2", 1), ("n3", 1)]
    assert rows(merge.merge_accounting(c), "contributed", "truncated") == [(4, 0)]


def test_concat_truncates_and_says_so(spark):
    c = contributions(spark, "[" + ",".join(["1"] * 10_005) + "]")
    assert merge.merge_concat(c, cap=10_000).count() == 10_000 and merge.merge_concat(c).count() == 10_005
    assert rows(merge.merge_accounting(c, cap=10_000), "contributed", "surfaced", "truncated") == [(10_005, 10_000, 5)]


def test_items_only_if_an_array(spark):
    c = contributions(spark, '{"items":3}', "[]", "not json")
    assert [r.i for r in merge.unwrap_items(c).select(F.to_json("item").alias("i")).collect()] == ['{"items":3}']


def test_dedupe_first_wins(spark):
    c = contributions(spark, '{"items":[{"id":"x","from":1},{"nokey":true}]}', '{"items":[{"id":"x","from":2},{"id":"y"}]}')
    got = merge.merge_dedupe(merge.unwrap_items(c), "id").select(F.to_json("item").alias("i"))
    assert rows(got, "i") == [('{"from":1,"id":"x"}',), ('{"id":"y"}',), ('{"nokey":true}',)]


def test_dedupe_identity_is_json_text(spark):
    c = contributions(spark, '[{"id":1},{"id":"1"},{"id":null},{"id":null},{"id":1}]')
    got = merge.merge_dedupe(merge.unwrap_items(c), "id")
    assert sorted(r.key_text for r in got.collect()) == ['"1"', "1", "null"]


def test_top_k(spark):
    c = contributions(spark, '[{"score":1.0,"n":"low"}]', '[{"score":9.0,"n":"hi"},{"score":5.0,"n":"mid"},{"score":"99","n":"text"}]')
    items = merge.unwrap_items(c)
    name = F.try_variant_get("item", "$.n", "string")
    assert [r[0] for r in merge.merge_top_k(items, 2).orderBy("rank").select(name).collect()] == ["hi", "mid"]
    assert [r[0] for r in merge.merge_top_k(items, 99).orderBy("rank").select(name).collect()] == ["hi", "mid", "low", "text"]
    assert [r[0] for r in merge.merge_rerank(items, 1).select(name).collect()] == ["hi"]


def test_aggregate(spark):
    c = contributions(spark, '[{"n":2.0},{"n":4.0}]', '[{"n":6.0},{"other":true},{"n":"7"}]')
    items = merge.unwrap_items(c)
    got = merge.merge_aggregate(items, ["sum", "count", "mean", "min"], "n")
    assert rows(got, "op", "value", "count") == [("count", 3.0, 3), ("mean", 4.0, 3), ("min", 2.0, 3), ("sum", 12.0, 3)]
    bad = merge.merge_aggregate(items, ["sum", "max"], "absent")
    assert {r.op: (r.value, r.reason is None) for r in bad.collect()} == {"sum": (0.0, True), "max": (None, False)}


@pytest.mark.parametrize("policy,ok,outcome", [("return_partial", 1, "merged"), ("return_partial", 0, "failed"), ("wait", 1, "failed"), ("fail_fast", 2, "merged")])
def test_settle(spark, policy, ok, outcome):
    c = contributions(spark, *["1"] * ok)
    if ok < 2:
        c = c.unionByName(contributions(spark, *["1"] * (2 - ok), status="timed_out").withColumn("node_id", F.concat(F.lit("z"), F.col("node_id"))))
    assert [r.outcome for r in merge.settle(c, policy).collect()] == [outcome]


def test_failure_summary_is_bounded(spark):
    data = [("r", f"n{i}", "failed", 1, None, "e" * 200 if i == 0 else "") for i in range(7)]
    c = spark.createDataFrame(data, "request_id string, node_id string, status string, duration_ms long, output string, error string")
    message = merge.failure_summary(c).collect()[0].message
    assert message.startswith("federated: 0/7 nodes ok; n0: " + "e" * 160 + "…; n1: failed")
    assert message.endswith("; …and 2 more")


# --- costs ---------------------------------------------------------------------------------------------------

NOW = datetime(2026, 8, 23, 12)


def test_utc_days(spark):
    df = spark.createDataFrame([(0,), (1787486400000,), (1709164800000,)], "ms long")
    assert rows(df, timefn.utc_day_of_ms(F.col("ms"))) == [("1970-01-01",), ("2024-02-29",), ("2026-08-23",)]


def test_ledger(spark):
    day = lambda n: datetime(2026, 8, n, 12)
    r = spark.createDataFrame([(day(23), "i", "P", 1.5), (day(22), "i", "P", 0.5), (day(23), "j", None, None)], "completed_at timestamp, issued_by string, plan_id string, cost_usd double")
    got = {(x.kind, x.key): (x.usd, x.today_usd) for x in costs.cost_totals(r, F.lit(NOW)).collect()}
    assert got == {("total", ""): (2.0, 1.5), ("day", "2026-08-23"): (1.5, None), ("day", "2026-08-22"): (0.5, None), ("issuer", "i"): (2.0, None), ("plan", "P"): (2.0, None)}
    text_ = '{"plan_id":"P","name":"demo","status":"done","budget":{"spent_usd":2.0,"cap_usd":5.0,"triggered":false}}'
    a = spark.createDataFrame([("t", NOW, text_)], "task_id string, completed_at timestamp, output string")
    assert rows(costs.plan_costs(r, a), "plan_id", "name", "actual_usd", "cap_usd", "reported_spent_usd", "triggered") == [("P", "demo", 2.0, 5.0, 2.0, False)]


def test_pricing(spark):
    u = spark.createDataFrame([("abc-1", 1_000_000, 0), ("abx", 0, 1_000_000), ("zzz", 1, 1)], "model string, prompt_tokens long, completion_tokens long")
    rates = spark.createDataFrame([("ab", 1.0, 2.0), ("abc", 3.0, 4.0)], "prefix string, usd_in double, usd_out double")
    over = spark.createDataFrame([("abc", 30.0, 4.0)], "prefix string, usd_in double, usd_out double")
    assert {r.model: r.price_usd for r in costs.price_usage(u, rates, over).collect()} == {"abc-1": 30.0, "abx": 2.0, "zzz": None}


def test_budget_fires_once_and_hard_cap_silences_soft(spark):
    steps = spark.createDataFrame(
        [("p", i, datetime(2026, 1, 1, i), c) for i, c in enumerate([1.0, float("nan"), -5.0, 1.0, 1.0, 9.0])] + [("q", 0, NOW, 7.0), ("q", 1, NOW, 7.0)],
        "plan_id string, step_id int, settled_at timestamp, cost_usd double",
    )
    limits = spark.createDataFrame([("p", 2.5, 1.5), ("q", 6.0, 1.0)], "plan_id string, cap_usd double, soft_usd double")
    got = rows(costs.budget_verdicts(steps, limits), "plan_id", "step_id", "verdict", "spent")
    assert got == [("p", 3, "soft_crossed", 2.0), ("p", 4, "exceeded", 3.0), ("q", 0, "exceeded", 7.0)]


@pytest.mark.parametrize(
    "own,cap,ceiling,want",
    [(False, None, None, 5.0), (True, 9.0, None, 9.0), (True, None, None, None), (True, None, 3.0, 3.0), (True, 9.0, 3.0, 3.0), (True, float("nan"), None, 0.0), (True, -1.0, None, 0.0)],
)
def test_effective_budget(spark, own, cap, ceiling, want):
    p = spark.createDataFrame([("p", own, cap, None, "pause")], "plan_id string, has_budget boolean, max_cost_usd double, soft_limit_usd double, on_exceed string")
    assert costs.effective_budget(p, 5.0, ceiling).collect()[0].cap_usd == want


def test_run_rate(spark):
    d = spark.createDataFrame([("2026-08-20", 4.0), ("2026-08-23", 4.0), ("2026-01-01", 99.0)], "day string, usd double")
    got = costs.run_rate(d, date(2026, 8, 23)).collect()[0]
    assert (got.elapsed_days, got.run_rate_usd) == (4, 60.0)
    young = costs.run_rate(d.filter("day = '2026-08-23'"), date(2026, 8, 23)).collect()[0]
    assert young.run_rate_usd is None


# --- lifecycle -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_lww_does_not_depend_on_order_or_partitioning(spark, seed):
    rnd = random.Random(seed)
    states = ["submitted", "planned", "dispatched", "claimed", "running", "expired", "cancelled", "failed", "done"]
    data = [(f"t{rnd.randrange(4)}", rnd.choice(states), datetime(2026, 1, 1, rnd.randrange(3)), rnd.choice("abc")) for _ in range(200)]
    make = lambda d, n: spark.createDataFrame(d, "task_id string, state string, at timestamp, source string").repartition(n)
    want = rows(lifecycle.lww_latest(make(data, 1)), "task_id", "state", "at", "source")
    shuffled = data + rnd.sample(data, 50)
    rnd.shuffle(shuffled)
    assert rows(lifecycle.lww_latest(make(shuffled, 7)), "task_id", "state", "at", "source") == want
    key = lambda r: (states.index(r[1]), r[2], r[3])
    assert want == sorted(max((r for r in data if r[0] == t), key=key) for t in {r[0] for r in data})
    again = lifecycle.lww_changes(make(data, 3), lifecycle.lww_latest(make(data, 2)))
    assert again.count() == 0


def test_retry_defaults(spark):
    t = spark.createDataFrame([("t", 9)], "id string, max_attempts int")
    got = [r.backoff_ms for r in lifecycle.retry_schedule(t).orderBy("attempt").collect()]
    assert got == [250, 500, 1000, 2000, 4000, 8000, 16000, 30000, 30000]


def test_lease_ends_count(spark):
    l = spark.createDataFrame([("l", "t", "w", datetime(2026, 1, 1), datetime(2026, 1, 2), 1)], "lease_id string, task_id string, worker_id string, issued_at timestamp, expires_at timestamp, attempt int")
    e = spark.createDataFrame([(1, "t", datetime(2026, 1, 2)), (2, "t", datetime(2026, 1, 2, 0, 0, 1))], "event_id int, task_id string, at timestamp")
    assert rows(lifecycle.lease_at(l, e), "event_id") == [(1,)]


# --- audit ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain(spark, sf):
    keep = ["node_id", "seq", "at_ms", "action", "subject", "detail", "actor", "prev_hash", "entry_hash"]
    one = b.chain(spark, sf).filter("node_id = 'n00000001'").select(*keep, F.lit(None).cast("long").alias("received_at_ms"))
    return one.cache()


@pytest.fixture(scope="module")
def no_pins(spark):
    return spark.createDataFrame([], "pin_no long, node_id string, seq long, entry_hash string, first_seen_ms long, observed_at_ms long, status string")


def verdict(df):
    r = au.verify_chain(df).collect()[0]
    return r.broken_at_seq, r.through_seq


def test_chain_verifies(chain):
    assert verdict(chain) == (None, 64)


@pytest.mark.parametrize("field", ["subject", "detail", "actor", "at_ms"])
def test_edited_field_breaks(chain, field):
    value = F.lit(1).cast("long") if field == "at_ms" else F.lit("x")
    assert verdict(chain.withColumn(field, F.when(F.col("seq") == 9, value).otherwise(F.col(field)))) == (9, None)


def test_null_is_not_empty(chain):
    assert verdict(chain.withColumn("subject", F.coalesce("subject", F.lit(""))))[0] is not None


def test_unknown_action_breaks(chain):
    assert verdict(chain.withColumn("action", F.when(F.col("seq") == 5, "made.up").otherwise(F.col("action")))) == (5, None)


def test_deleted_middle_breaks_deleted_tail_does_not(chain):
    assert verdict(chain.filter("seq <> 20")) == (21, None)
    assert verdict(chain.filter("seq < 20")) == (None, 19)


def test_deleted_prefix_is_unanchored_unless_pinned(chain, no_pins):
    cut = chain.filter("seq > 7")
    assert rows(au.anchor_check(cut, no_pins), "anchor") == [("unanchored",)]
    pin = chain.filter("seq = 7").select(F.lit(1).cast("long").alias("pin_no"), "node_id", "seq", "entry_hash", F.lit(0).cast("long").alias("first_seen_ms"), F.lit(0).cast("long").alias("observed_at_ms"), F.lit("unchecked").alias("status"))
    assert rows(au.anchor_check(cut, pin), "anchor") == [("pin",)]
    assert rows(au.anchor_check(chain, no_pins), "anchor") == [("genesis",)]


def test_prune_leaves_a_marked_verifiable_chain(chain, no_pins):
    pruned = au.prune_with_marker(chain, 10, 1)
    assert pruned.count() == 11
    assert verdict(pruned) == (None, 65)
    assert rows(au.anchor_check(pruned, no_pins), "anchor") == [("marker",)]
    assert au.prune_with_marker(chain, 64, 1).count() == 64


def test_forks_name_the_hash_seen_first(spark):
    a = spark.createDataFrame([("n", 1, "a", 5), ("n", 1, "b", 3), ("n", 1, "c", 9), ("n", 2, "a", 1), ("n", 2, "a", 2)], "node_id string, seq long, entry_hash string, at_ms long")
    assert rows(au.find_forks(a), "seq", "held_hash", "other_hash") == [(1, "b", "a"), (1, "b", "c")]


def test_pins_of_one_instant_do_not_defeat_thinning(spark):
    p = spark.createDataFrame([(i, "n", i + 1, "h", 1000, 1000, "contradicted" if i == 3 else "unchecked") for i in range(20)], "pin_no long, node_id string, seq long, entry_hash string, first_seen_ms long, observed_at_ms long, status string")
    assert [r.pin_no for r in pins.thin_pins(p, 4, 1000).orderBy("pin_no").collect()] == [0, 3, 16, 17, 18, 19]


def test_next_pin_ignores_the_claimed_height(spark):
    p = spark.createDataFrame([(1, "n", 2**62, "h", 10, 10, "unchecked"), (2, "n", 5, "g", 10, 10, "unchecked"), (3, "n", 9, "f", 4, 99, "unchecked")], "pin_no long, node_id string, seq long, entry_hash string, first_seen_ms long, observed_at_ms long, status string")
    assert rows(pins.next_pin(p), "seq") == [(5,)]


def test_classify_heads(spark):
    held = spark.createDataFrame([("n", 10, "a")], "node_id string, seq long, entry_hash string")
    heads = spark.createDataFrame([(1, "n", 10, "a"), (2, "n", 10, "b"), (3, "n", 4, "c"), (4, "n", 12, "d"), (5, "n", 12, "e"), (6, "n", 0, "f"), (7, "n", 11, "g")], "head_no long, node_id string, seq long, entry_hash string")
    got = {r.head_no: r.outcome for r in pins.classify_pins(heads, held).collect()}
    assert got == {1: "refreshed", 2: "fork", 3: "stale_pinned", 4: "pinned", 5: "fork", 6: "rejected_seq", 7: "stale_pinned"}


def test_burst_of_a_thousand_denials(spark):
    data = [(i, 1_000_000 + i * 50, "shell.denied", "peer", f"/bin/x{i}") for i in range(1000)]
    df = spark.createDataFrame(data, "row_id long, at_ms long, action string, actor string, subject string")
    got = fr.suppress_bursts(df)
    assert got.filter("kind = 'entry'").count() == 10
    s = got.filter("kind = 'summary'").collect()
    assert [(r.suppressed_repeats, r.distinct_subjects, r.distinct_subjects_capped, len(r.sample_subjects)) for r in s] == [(990, 64, True, 8)]
    assert s[0].sample_subjects[0] == "/bin/x10"


# --- corpus and search ---------------------------------------------------------------------------------------


def docs(spark, *pairs):
    return spark.createDataFrame([("s", p, c) for p, c in pairs], "scope string, path string, content string")


def test_grep(spark):
    d = docs(spark, ("a/x.rs", "one\nTwo two\r\n\n"), ("a.txt", "two"), ("bin", "two\x00"), ("empty", ""))
    got = corpus.grep(d, "two")
    assert rows(got, "path", "line_number", "line") == [("a.txt", 1, "two"), ("a/x.rs", 2, "Two two")]
    assert corpus.grep(d, ".*", file_glob="empty").count() == 0
    assert rows(corpus.grep(d, "TWO", literal=True, ignore_case=True, file_glob="*.rs"), "path") == [("a/x.rs",)]
    assert corpus.grep(d, "t.o", literal=True).count() == 0
    assert [r.path for r in corpus.grep(d, "two", max_results=1).collect()] == ["a/x.rs"]
    s = corpus.grep_stats(d, "two", max_results=2).collect()[0]
    assert (s.files_scanned, s.skipped_binary, s.matches, s.truncated) == (3, 1, 2, True)


def test_long_lines_are_cut_between_characters(spark):
    line = "a" * 511 + "é" + "b" * 50
    r = corpus.grep(docs(spark, ("p", line)), "a").collect()[0]
    assert (r.line, r.line_truncated) == ("a" * 511, True)
    for limit in range(4, 12):
        s = "aé€😀b€é"
        raw = s.encode()[:limit].decode(errors="ignore")
        assert spark.range(1).select(text.truncate_bytes(F.lit(s), limit)).collect()[0][0] == raw


@pytest.mark.parametrize(
    "glob,path,hit",
    [("*.rs", "src/main.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**.rs", "src/a/b.rs", True), ("a?c", "x/abc", True), ("a.c", "abc", False), ("*", "a/b", True)],
)
def test_globs(spark, glob, path, hit):
    assert (corpus.glob_filter(docs(spark, (path, "")), "path", glob).count() == 1) == hit


def test_search_ranks_denser_first_and_follows_changes(spark):
    d = docs(spark, ("a", "garlic " * 5 + "pan"), ("b", "garlic and onion and butter and salt"), ("c", "soup"), ("d", "tea"), ("e", "nut\x00"))
    hits = search.search(search.build_index(d), ["Garlic"]).collect()
    assert [h.path for h in hits] == ["a", "b"] and hits[0].score > hits[1].score
    assert search.search(search.build_index(d), ["garlic"], limit=1).count() == 1
    assert search.search(search.build_index(d), ["garlic"], not_terms=["onion"]).count() == 1
    v = lambda *p: docs(spark, *p).withColumn("version", F.sha2("content", 256))
    change = search.index_diff(v(("a", "phoenix"), ("b", "same"), ("n", "new")), v(("a", "dragon"), ("b", "same"), ("z", "gone")))
    assert rows(change, "path", "change") == [("a", "updated"), ("b", "unchanged"), ("n", "added"), ("z", "removed")]
    kept = search.index_diff(v(("a", "x")), v(("z", "gone")), listing_truncated=True)
    assert rows(kept, "path", "change") == [("a", "added"), ("z", "unchanged")]


def test_phrase_counts_overlaps(spark):
    hits = search.search_phrase(docs(spark, ("a", "no no no."), ("b", "no, maybe no"), ("c", "x")), "No no").collect()
    assert [(h.path, h.occurrences) for h in hits] == [("a", 2)]


def test_stored_index_gives_the_same_hits(spark, sf, tmp_path):
    index = search.build_index(b.docs(spark, sf))
    search.write_index(index, str(tmp_path / "i"), buckets=8)
    stored = search.read_index(spark, str(tmp_path / "i"))
    find = lambda i: [(r.path, round(r.score, 9)) for r in search.search(i, ["the", "of"], limit=50).collect()]
    assert find(stored) == find(index) and len(find(stored)) > 5


def test_corpus_reader_and_exports(spark, tmp_path):
    from fleetlens.sources.corpus import read_corpus
    from fleetlens.sources.export import export_audit_csv

    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "sub" / "a.txt").write_text("héllo")
    (tmp_path / "c" / "b.md").write_text("no")
    got = read_corpus(spark, str(tmp_path / "c"), "*.txt")
    assert rows(got, "path", "content", "size_bytes") == [("sub/a.txt", "héllo", 6)]
    a = spark.createDataFrame([("n", 1, 0, "shell.denied", '=cmd|"x",1', None, "p", "h")], "node_id string, seq long, at_ms long, action string, subject string, detail string, actor string, entry_hash string")
    export_audit_csv(a, str(tmp_path / "csv"))
    body = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert '"\'=cmd|""x"",1"' in body and '"1970-01-01 00:00:00"' in body


def test_vectors_in_pages(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(7)], "query_id string, embedding array<float>")
    monkeypatch.setattr(search, "MAX_QUERY_PAGE", 3)
    got = search.embed_lookup(v, q, 2)
    assert rows(got, "query_id", "rank", "vec_id") == sorted((f"q{i}", r, x) for i in range(7) for r, x in ((1, 49), (2, 48)))


# --- placement and rules -------------------------------------------------------------------------------------

NODE = {
    "capability": "c", "node_id": "n", "cpu_cores": 4, "ram_total_mb": 1000, "ram_used_mb": 0, "has_gpu": False, "gpu_total_mb": 0, "gpu_used_mb": 0,
    "cpu_busy_pct": 0, "cpu_pinned_count": 0, "reported_inflight": 0, "assigned_inflight": 0, "paused": False, "on_battery": False,
}
TASK = {"capability": "c", "cpu_class": "heavy", "memory_mb": None, "gpu_required": False, "gpu_memory_mb": None}


def fit(spark, task=None, node=None):
    t = spark.createDataFrame([TASK | (task or {})], "capability string, cpu_class string, memory_mb int, gpu_required boolean, gpu_memory_mb int")
    n = spark.createDataFrame([NODE | (node or {})])
    got = placement.rank_candidates(t, n).collect()
    return got[0].score if got else 0.0


def test_fit_score(spark):
    assert fit(spark, node={"paused": True}) == 0
    assert fit(spark, task={"gpu_required": True}) == 0
    assert fit(spark, task={"memory_mb": 2000}) == 0
    assert fit(spark, task={"cpu_class": "pinned"}, node={"cpu_pinned_count": 4}) == 0
    assert fit(spark, node={"cpu_busy_pct": 100, "ram_used_mb": 1000}) == pytest.approx(0.05 * 0.05)
    plain = fit(spark)
    assert plain == pytest.approx(0.75 * (1 - 0.256))
    assert fit(spark, node={"on_battery": True}) == pytest.approx(plain / 2)
    assert fit(spark, node={"ram_total_mb": 0}) == pytest.approx(0.75)


def test_node_score(spark):
    base = {"node_id": "0" * 32, "cpu_cores": 1, "ram_gb": 1, "has_local_fast_planner": False, "has_local_strong_planner": False, "has_cloud_planner_keys": False, "on_battery_unplugged": False, "recently_demoted": 0, "planner_error_rate_pct": 0}
    score = lambda **k: placement.node_score(spark.createDataFrame([base | k])).collect()[0].score
    assert score() == 30
    assert score(has_local_fast_planner=True) == 130
    assert score(recently_demoted=9) == -170


def decide(spark, request, rule_rows, trust=(), **kw):
    base = {"request_id": 1, "kind": "shell", "from_node": "n", "cmd": None, "args": None, "model": None, "server": None, "tool": None}
    r = spark.createDataFrame([base | request], "request_id long, kind string, from_node string, cmd string, args array<string>, model string, server string, tool string")
    names = ["kind", "effect", "rule_no", "cmd", "any_args", "subcmds", "pattern", "model", "model_prefix", "server", "tool"]
    schema = "kind string, effect string, rule_no int, cmd string, any_args boolean, subcmds array<string>, pattern string, model string, model_prefix string, server string, tool string"
    rs = spark.createDataFrame([tuple(x.get(n) for n in names) for x in rule_rows], schema)
    t = spark.createDataFrame(list(trust), "kind string, node string, level string")
    got = rules.evaluate_rules(r, rs, t, **kw).collect()[0]
    return got.decision, got.reason


def test_rules(spark):
    allow = {"kind": "shell", "effect": "allow", "rule_no": 9, "cmd": "charm", "any_args": True}
    sh = {"cmd": "charm", "args": ["x"]}
    assert decide(spark, sh, []) == ("deny", "no_rule_matched")
    assert decide(spark, sh, [allow]) == ("allow", "allow_rule")
    assert decide(spark, sh, [allow, {"kind": "shell", "effect": "deny", "rule_no": 10, "pattern": "rm"}]) == ("deny", "deny_rule")
    assert decide(spark, sh, [allow, {"kind": "shell", "effect": "deny", "rule_no": 1, "pattern": ".*"}]) == ("allow", "allow_rule")
    assert decide(spark, sh, [allow], [("shell", "*", "untrusted")]) == ("deny", "untrusted_source")
    assert decide(spark, sh, [allow], [("shell", "*", "untrusted"), ("shell", "n", "trusted")]) == ("allow", "allow_rule")
    git = {"kind": "shell", "effect": "allow", "rule_no": 1, "cmd": "git", "subcmds": ["log"], "any_args": True}
    assert decide(spark, {"cmd": "git", "args": ["push"]}, [git])[0] == "deny"
    assert decide(spark, {"cmd": "git", "args": ["log", "-1"]}, [git])[0] == "allow"
    assert decide(spark, {"cmd": "git", "args": []}, [git])[0] == "deny"
    llm = {"kind": "llm", "model": "m1"}
    assert decide(spark, llm, [], llm_section=False) == ("allow", "no_section")
    assert decide(spark, llm, []) == ("deny", "empty_section")
    assert decide(spark, {"kind": "mcp", "server": "s", "tool": "t"}, [{"kind": "mcp", "effect": "allow", "rule_no": 1, "server": "s"}])[0] == "allow"


def test_rules_beyond_one_page(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULE_PAGE", 2)
    many = [{"kind": "shell", "effect": "allow", "rule_no": i, "cmd": f"c{i}", "any_args": True} for i in range(5)]
    assert decide(spark, {"cmd": "c4", "args": []}, many) == ("allow", "allow_rule")


# --- plans ---------------------------------------------------------------------------------------------------


def plan(spark, ids, pairs):
    n = spark.createDataFrame([("p", i, "c", "{}") for i in ids], "plan_id string, node_id string, capability string, input string")
    return n, spark.createDataFrame([("p", *e) for e in pairs], "plan_id string, from_id string, to_id string")


def test_layers(spark):
    n, e = plan(spark, "abcdx", [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "c"), ("x", "x")])
    got = {r.node_id: (r.layer, r.cycle) for r in graph.topo_layers(n, e).collect()}
    assert got == {"a": (0, False), "b": (1, False), "c": (1, False), "d": (2, False), "x": (None, True)}


def test_plan_limits(spark):
    n, e = plan(spark, [f"s{i:02}" for i in range(65)], [("s01", "s00"), ("s01", "gone")])
    plans = spark.createDataFrame([("p", 1.0, None, None, False), ("q", 1.0, 0.5, 0.9, False)], "plan_id string, estimated_usd double, max_cost_usd double, budget_usd double, must_be_local boolean")
    caps = spark.createDataFrame([("c", False)], "capability string, cloud boolean")
    got = rows(graph.validate_plans(plans, n, e, caps), "plan_id", "reason", "detail")
    assert got == [("p", "dangling_edge", "s01>gone"), ("p", "too_large", "65"), ("q", "budget_inconsistent", ""), ("q", "cost_exceeded", ""), ("q", "empty", "")]
    assert graph.topo_layers(n, e).filter("not cycle").count() == 65


def test_cascade_skips_only_waiting_dependents(spark):
    _, e = plan(spark, "abcd", [("b", "a"), ("c", "b"), ("d", "c"), ("e", "a")])
    s = spark.createDataFrame([("p", "a", "failed"), ("p", "b", "waiting"), ("p", "c", "waiting"), ("p", "d", "done"), ("p", "e", "in_flight")], "plan_id string, node_id string, state string")
    assert rows(graph.skip_cascade(e, s), "node_id") == [("b",), ("c",)]


def test_refs(spark):
    inputs = {
        "a": '{"x":[{"$task_output":"o","pointer":"/k~1y/1"},"\\"$task_output\\":"],"y":{"$task_output":"o"}}',
        "b": '{"$task_output":"o","pointer":"/nope"}',
        "c": '{"$task_output":"missing"}',
        "d": '{"$task_output":"o","extra":1}',
        "e": '{"plain":1}',
    }
    n = spark.createDataFrame([("p", k, v) for k, v in inputs.items()], "plan_id string, node_id string, input string")
    o = spark.createDataFrame([("p", "o", '{"k/y":[0,{"$task_output":"o"}]}')], "plan_id string, node_id string, output string")
    got = {r.node_id: (r.resolved_input, r.reason) for r in refs.resolve_refs(n, o).collect()}
    assert got["a"] == ('{"x":[{"$task_output":"o"},"\\"$task_output\\":"],"y":{"k/y":[0,{"$task_output":"o"}]}}', None)
    assert {k: v[1] for k, v in got.items()} == {"a": None, "b": "pointer_miss", "c": "unknown_task", "d": "malformed_ref", "e": None}
    assert got["e"][0] == '{"plain":1}'


def test_step_hash_ignores_key_order(spark):
    n = spark.createDataFrame([("p", "a", "c", '{"x":1,"y":2}'), ("p", "b", "c", '{ "y":2, "x":1 }'), ("p", "d", "c", '{"x":2}')], "plan_id string, node_id string, capability string, input string")
    h = {r.node_id: r.input_hash for r in cp.step_hashes(n).collect()}
    assert h["a"] == h["b"] != h["d"]


def test_live_plans_are_not_swept(spark):
    done = '{"status":"done","ok":3,"failed":0,"timed_out":0,"skipped":0}'
    c = spark.createDataFrame([("p", "s"), ("q", "s"), ("r", "s")], "plan_id string, node_id string")
    t = spark.createDataFrame([("1", "p", "done"), ("2", "q", "done"), ("3", "q", "running"), ("4", "r", "done")], "id string, plan_id string, state string").withColumn("capability", F.lit("plan.execute"))
    r = spark.createDataFrame([("1", done), ("2", done), ("4", '{"status":"done","ok":2,"failed":1,"timed_out":0,"skipped":0}')], "task_id string, output string")
    assert rows(cp.completed_plans(c, t, r), "plan_id") == [("p",)]


def test_plan_verdict_precedence(spark):
    s = spark.createDataFrame([(p, i, st, False) for p in "abcd" for i, st in enumerate(["done", "waiting"])] + [("e", 0, "done", True), ("f", 0, "failed", False)], "plan_id string, step_id int, state string, replayed boolean")
    p = spark.createDataFrame([("a", False, False, "paused"), ("b", True, False, "paused"), ("c", False, True, "paused"), ("d", False, False, None), ("e", True, False, "paused"), ("f", False, False, None)], "plan_id string, deadline_hit boolean, aborted boolean, budget_stop string")
    got = {r.plan_id: (r.status, r.error) for r in summary.plan_summary(s, p).collect()}
    assert got == {"a": ("paused", None), "b": ("failed", "plan deadline exceeded"), "c": ("failed", "plan aborted (fail_fast)"), "d": ("done", None), "e": ("done", None), "f": ("failed", "no step succeeded")}


# --- telemetry -----------------------------------------------------------------------------------------------


def test_liveness_is_strict(spark):
    h = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 1, 0, 0, 1))], "node_id string, ts timestamp")
    assert rows(telemetry.liveness(h, F.lit(datetime(2026, 1, 1, 0, 0, 6))), "node_id", "live") == [("a", False), ("b", True)]


def test_replay_of_seq_zero(spark):
    f = spark.createDataFrame([("n", "c", 1, 0), ("n", "c", 2, 0), ("n", "c", 3, 5), ("n", "c", 4, 4), ("n", "d", 5, 4)], "node_id string, channel string, arrival long, seq long")
    assert rows(telemetry.reject_replays(f), "arrival", "accepted") == [(1, True), (2, False), (3, True), (4, False), (5, True)]


def test_ring(spark):
    p = spark.range(501).select(F.lit("t").alias("task_id"), F.col("id").alias("seq"))
    got = telemetry.ring_tail(p)
    assert (got.count(), got.agg(F.min("seq"), F.max("dropped")).collect()[0]) == (500, (1, 1))


def test_progress(spark):
    lines = ['{"step":{"id":"a","state":"done"}}', '{"step":{"id":"a","state":"in_flight"}}', "junk{", '{"step":{"id":"b","state":"in_flight"}}']
    p = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines)], "task_id string, seq long, line string")
    sizes = spark.createDataFrame([("t", 4)], "task_id string, plan_size int")
    assert rows(telemetry.progress(p, sizes), "settled_steps", "steps_seen", "fraction") == [(1, 2, 0.25)]


@pytest.mark.parametrize("pattern,benched", [("FFFFF", 1), ("FFFFSFFFF", 0), ("FFFFFS", 1), ("FFFF", 0)])
def test_breaker(spark, pattern, benched):
    o = spark.createDataFrame([("n", datetime(2026, 1, 1, 0, 0, i), i, c == "S") for i, c in enumerate(pattern)], "node_id string, at timestamp, outcome_id int, ok boolean")
    assert telemetry.breaker(o).count() == benched


def test_success_rate_floor(spark):
    o = spark.createDataFrame([("n", datetime(2026, 1, 1, 0, i % 60), i, i == 39) for i in range(40)], "node_id string, at timestamp, outcome_id int, ok boolean").orderBy("outcome_id")
    rate = 1.0
    for i in range(40):
        rate = max(0.8 * rate + 0.2 * (i == 39), 0.05)
    assert telemetry.success_rate(o).collect()[0].success_rate == pytest.approx(rate)


def test_genesis_hash_is_zero(chain):
    assert chain.filter("seq = 1").collect()[0].prev_hash == ZERO_HASH


def test_listing_says_when_it_is_cut(spark):
    d = spark.createDataFrame([("a/b/c.txt", 3), ("a/d.txt", 4), ("e.txt", 5)], "path string, size long")
    got = corpus.list_inventory(d, max_depth=2, max_entries=2)
    assert rows(got, "entry", "kind", "depth", "truncated") == [("a", "dir", 1, True), ("e.txt", "file", 1, True)]
    below = corpus.list_inventory(d, "a", max_depth=8)
    assert rows(below, "entry", "kind", "truncated") == [("b", "dir", False), ("b/c.txt", "file", False), ("d.txt", "file", False)]


def test_large_documents_are_scanned_and_counted_where_they_are_not(spark):
    body = "filler words here\n" * 520_000 + "needle at the end"
    docs = spark.createDataFrame([("s", "big.txt", body), ("s", "small.txt", "one needle")], "scope string, path string, content string")
    assert rows(corpus.grep(docs, "needle"), "path", "line_number") == [("big.txt", 520_001), ("small.txt", 1)]
    assert rows(corpus.grep(docs, "needle", max_bytes=1 << 20), "path") == [("small.txt",)]
    assert rows(corpus.grep_stats(docs, "needle", max_bytes=1 << 20), "files_scanned", "skipped_too_large", "matches") == [(1, 1, 1)]
    assert rows(search.search(search.build_index(docs), ["Needle"]), "path") == [("big.txt",), ("small.txt",)]
    assert rows(search.index_skips(docs, 1 << 20), "too_large", "binary") == [(1, 0)]


def test_binary_probe_counts_bytes(spark):
    docs = spark.createDataFrame([("s", "a", "é" * 5000 + "\x00"), ("s", "b", "é" * 4000 + "\x00")], "scope string, path string, content string")
    assert rows(corpus.classify_files(docs, 1 << 20), "path", "binary") == [("a", False), ("b", True)]


def test_plans_beyond_64_steps(spark):
    nodes = spark.createDataFrame([("p", f"s{i}") for i in range(70)], "plan_id string, node_id string")
    edges = spark.createDataFrame([("p", f"s{i}", f"s{i // 2}") for i in range(1, 70)], "plan_id string, from_id string, to_id string")
    assert rows(graph.topo_layers(nodes, edges), "node_id", "layer", "cycle")[1] == ("s1", 1, False)
    states = nodes.withColumn("state", F.when(F.col("node_id") == "s0", "failed").otherwise("waiting"))
    assert graph.skip_cascade(edges, states).count() == 69


def test_an_older_batch_replaces_nothing_and_a_broken_one_is_not_seen(spark, tmp_path):
    from fleetlens.sources.upsert import read_upserted, upsert

    folder = str(tmp_path / "t")
    for v in (10, 5):
        upsert(spark.createDataFrame([("k", v)], "id string, v int"), folder, ["id"], ["v"], buckets=2)
    assert rows(read_upserted(spark, folder), "id", "v") == [("k", 10)]
    (tmp_path / "t" / "manifest" / "9").mkdir()  # a manifest without its mark of completion
    assert rows(read_upserted(spark, folder), "v") == [(10,)]
    with pytest.raises(FileNotFoundError):
        read_upserted(spark, str(tmp_path / "none"))
