"""Settled ranks, texts that share an id, several automata, plain-Python learning, and pipeline stages on odd rows."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import decontaminate, link_trust, quality, rlz_dedup
from fleetlens.llm.common import BLOCK, stored
from fleetlens.llm.queries import ORACLES, QUERIES

M64 = (1 << 64) - 1


def test_ranks_settle_far_from_the_seeds(spark):
    r = random.Random(5)
    edges = {(f"h{k}", f"h{k + 1}"): 1 for k in range(60)}
    for _ in range(80):
        edges[f"h{r.randrange(61)}", f"h{r.randrange(61)}"] = r.randrange(1, 4)
    seeds = [("h0", 0.75, 0.0), ("h3", 0.25, 0.5), ("h60", 0.0, 0.5)]
    got = {x.host: (x.trust, x.distrust) for x in link_trust.propagate(spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for side, ways in ((0, edges), (1, {(b, a): n for (a, b), n in edges.items()})):
        start = {s[0]: s[1 + side] for s in seeds}
        out = {}
        for (a, _), n in ways.items():
            out[a] = out.get(a, 0) + n
        rank = dict(start)
        for _ in range(400):
            after = {h: 0.15 * v for h, v in start.items()}
            for (a, b), n in ways.items():
                after[b] = after.get(b, 0.0) + 0.85 * rank.get(a, 0.0) * n / out[a]
            rank = after
        assert all(math.isclose(got[h][side] if h in got else 0.0, v, abs_tol=1e-8) for h, v in rank.items())
    assert got["h40"][0] > 0 and link_trust.most_rounds() > 100


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_every_text_of_the_smallest_id_is_asked_for(spark, parts):
    passage = [f"p{k}" for k in range(30)]
    rows = [(5, [f"a{k}" for k in range(9)] + passage), (5, passage + [f"b{k}" for k in range(9)]), (5, passage + [f"b{k}" for k in range(9)]), (7, passage), (3, ["c", *passage]), (8, passage[:12])]
    rows = [(i, " ".join(w)) for i, w in rows]
    # Rows of id 5 in one task, their smaller source in another; then all mixed.
    df = spark.createDataFrame(rows[:4], "doc_id long, text string").coalesce(1).unionAll(spark.createDataFrame(rows[4:], "doc_id long, text string").coalesce(1))
    if parts != 2:
        df = df.repartition(parts)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in rlz_dedup.substring_dedup(df).collect())
    assert got == [(3, 31, 0), (5, 39, 30), (5, 39, 30), (5, 39, 30), (7, 30, 30), (8, 12, 0)]


def test_answers_of_a_hot_passage_are_dealt_out():
    n = 4_000
    h, doc = np.full(n, 77, np.uint64), np.arange(n, dtype=np.int64)
    for kind in ("anchor", "block"):
        sent = list(rlz_dedup._send(kind, h, doc, doc, np.zeros(n, np.int32), np.zeros(n, np.int32), 64))
        sizes = {b: len(x) // 8 for batch in sent for b, x in zip(batch.column("bucket").to_pylist(), batch.column("doc").to_pylist())}
        assert sizes.pop(0) == 1 and sum(sizes.values()) >= n - 1
        assert len(sizes) == 64 and max(sizes.values()) < 3 * n / 64


def test_many_automata_find_what_one_finds(spark):
    r = random.Random(9)
    bench = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(1, 14)))) for k in range(40)]
    docs = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(60)) + " " + bench[k % 40][1]) for k in range(30)] + [(90, None), (91, ""), (92, bench[3][1] * 400)]
    items, table = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    find = lambda chars: sorted(decontaminate.find_benchmark(table, items, chars=chars).collect(), key=lambda x: x.doc_id)
    whole = find(1 << 20)
    assert find(300) == find(1_500) == whole and sum(x.n_hit > 0 for x in whole) >= 30


def word_hash(word: bytes) -> int:
    return mixed(sum((b + 1) * pow(0x9E3779B97F4A7C15 | 1, j, 1 << 64) for j, b in enumerate(word)) & M64)


def mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def grams(tokens: list[int], n: int, seed: int) -> list[int]:
    out = []
    for k in range(len(tokens) - n + 1):
        value = 0
        for t in tokens[k : k + n]:
            value = (value * (seed | 1) + mixed(t ^ seed)) & M64
        out.append(mixed(value))
    return out


def plain_features(text: str) -> list[int]:
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x20 0-9A-Za-z\x80-\xff]+", text.encode())
    hashes = [word_hash(t) for t in tokens]
    is_word = [re.match(rb"[0-9A-Za-z\x80-\xff]", t) is not None for t in tokens]
    kinds = [bool(re.search(rb"[A-Z]", t)) + 2 * bool(re.search(rb"[a-z]", t)) + 4 * bool(re.search(rb"[0-9]", t)) for t in tokens]
    shapes = [mixed(k + 101) if w else h for k, w, h in zip(kinds, is_word, hashes)]
    again = [mixed((k > 0 and hashes[k] == hashes[k - 1]) + 2 * (k > 1 and hashes[k] == hashes[k - 2]) + 977) for k in range(len(tokens))]
    every = [g for n in (1, 2) for g in grams(hashes, n, 11 + n)] + [g for n in (1, 2, 3) for g in grams(shapes, n, 21 + n)] + again
    return [g >> (64 - quality.BITS) for g in every]


def plain_ftrl(rows: list[tuple[str, int]], epochs: int):
    z, n, bias = {}, {}, 1 << quality.BITS

    def weight(i: int) -> float:
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(v - math.copysign(quality.L1, v)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    data = []
    for text, y in rows:
        count = {}
        for i in (found := plain_features(text)):
            count[i] = count.get(i, 0) + 1
        data.append(({i: c / math.sqrt(max(1, len(found))) for i, c in count.items()} | {bias: 1.0}, y))
    for _ in range(epochs):
        for x, y in data:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_learning_and_scores_equal_plain_python(spark):
    texts = ["Good plain words, told well. Told well!", "BUY!!! now $$$ BUY buy 100%", "", "ünï çode 12 Ab3 ab3", "x", "... ...", "a b a b a b " * 20]
    rows = [(t, k % 2) for k, t in enumerate(texts)]
    for t, _ in rows:
        assert sorted(quality.features(np.frombuffer(t.encode(), np.uint8))) == sorted(plain_features(t))
    found = quality.fit_ftrl([(quality.features(np.frombuffer(t.encode(), np.uint8)), y) for t, y in rows], epochs=3)
    want = plain_ftrl(rows, 3)
    assert np.count_nonzero(found) == sum(w != 0 for w in want.values())
    assert all(abs(found[i] - w) < 1e-9 for i, w in want.items())
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    for r in quality.score(docs, found).collect():
        idx = plain_features(r.text or "")
        total = want.get(1 << quality.BITS, 0.0) + sum(want.get(i, 0.0) for i in idx) / math.sqrt(max(1, len(idx)))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_stages_take_odd_rows(spark, sf):
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(BLOCK // 8))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "One plain line"), (6, "One plain line"), (None, "No id here"), (None, None), (7, "one\n\n\ntwo")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket int, score double, n_words string")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), "stage")
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "packing":
            assert out.columns == docs.columns
        ids = sorted((r.doc_id for r in out.select("doc_id").distinct().collect()), key=lambda x: (x is None, x or 0))
        if name == "line dedup":
            assert out.count() == len(rows) and out.where("doc_id in (4, 5)").agg(F.min(F.length("text"))).first()[0] == len(long)
        if name == "near-duplicates":
            assert out.where("doc_id is null").count() == 2 and 4 in ids and 5 not in ids and {1, 2, 3, 6, 7} <= set(ids)
        if name == "benchmark decontamination":
            assert out.count() == len(rows)
        if name == "packing":
            assert {1, 2, 3, 4, 5, 6, 7, None} >= set(ids) >= {4, 5, 6, 7}


def test_url_query_equals_its_sql_on_pages_that_link_hosts(spark, tmp_path):
    r = random.Random(11)
    hosts = [f"h{k}.{r.choice(['com', 'net', 'org'])}" for k in range(40)] + ["example.com", "www.example.com"]
    rows = []
    for k in range(400):
        links = "".join(f'<a href="http://{r.choice(hosts)}/x">y</a>' for _ in range(r.randrange(4)))
        path = r.choice(["/en/a", "/es/b", "/fr/", "/de", ""])
        rows.append((k, r.choice([f"http://{r.choice(hosts)}{path}"] * 9 + [None, "no host", "http:///only/path"]), links))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op9_link_trust"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op9_link_trust']})").fetchall()
    rows = sorted(tuple(x) for x in got.select("page_id", "host", "path", "rule", "verdict").collect())
    assert rows == sorted(want) and {x[4] for x in rows if x[3] is None} == {"allow", "block"}
