"""Operators on rows with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names; brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import common, decontaminate, langid, line_templates, link_trust, minhash_forest, packing, quality, rlz_dedup, subspace_join, warc

DOCS = "doc_id long, text string, lang string, score double, items string, rep long, tx string, `key` string, a int"


def words(seed: int, n: int, kinds: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{r.randrange(kinds)}" for _ in range(n)]


BASE = words(1, 300)
EDITED = [*BASE[:100], "other", *BASE[101:]]
TEXTS = [
    (1, " ".join(BASE)),
    (2, " ".join(EDITED)),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, " ".join(words(2, 60_000, 100_000))),
    (7, "Two words"),
    (7, "Two words"),
    (8, "two WORDS"),
    (None, " ".join(BASE)),
    (None, None),
    (9, " ".join(words(3, 40) + BASE[50:90] + words(4, 40))),
    (10, "Ünïcode\x0btext\x1fwith marks \U0001f600 " + "x" * 300_000),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, 0.5, "x", 1, "t", "k", 3) for k, (i, t) in enumerate(rows)], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_word_hashes_do_not_depend_on_place():
    text = ("ab cd " * 100_000 + "ab").encode()
    raw = np.frombuffer(text, np.uint8)
    h = common.word_hashes(raw, *common.word_bounds(raw, common.NOT_SPACE))
    assert len(h) == 200_001 and len(set(h.tolist())) == 2
    assert [None if x is None else bytes(x) for x in common.texts(pa.array(["é", None, ""]))] == ["é".encode(), None, b""]


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(120)]
    r.shuffle(edges)
    got = {x.vertex: x.component for x in common.components(spark.createDataFrame(edges, common.EDGE).repartition(7)).collect()}
    touched = {v for e in edges if e[0] != e[1] for v in e}
    assert got == groups(touched, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], common.EDGE)).count() == 0


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rows = TEXTS + [(20 + k, " ".join(w if random.Random(f"{k}{j}").random() > 0.02 else "edit" for j, w in enumerate(BASE))) for k in range(25)]
    got = minhash_forest.near_duplicates(frame(spark, rows), n, percent).collect()
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, n))
    named = [i for i in sets if i is not None]
    links = [(i, j) for i, j in itertools.combinations(named, 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = groups(named, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(sets[r.doc_id]))
        else:
            assert r.component_id is None and r.kept
    assert minhash_forest.near_duplicates(frame(spark, []), n, percent).count() == 0


def test_several_texts_of_one_id_have_a_defined_result(spark):
    rows = [(1, " ".join(BASE)), (5, " ".join(EDITED)), (5, " ".join(words(9, 200))), (6, " ".join(words(9, 200)))]
    runs = [sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(frame(spark, x), 3, 85).collect()) for x in (rows, rows[::-1])]
    assert runs[0] == runs[1] and len(runs[0]) == 4


def test_rest_of_a_region_is_compared_in_blocks(spark, monkeypatch):
    """Without any first round all links come from the blocks of regions, of three rows each here."""
    monkeypatch.setattr(minhash_forest, "NEAREST", 0)
    monkeypatch.setattr(minhash_forest, "CHUNK", 3)
    rows = [(k, " ".join(w if random.Random(f"{k}{j}").random() > 0.015 else f"e{k}" for j, w in enumerate(BASE))) for k in range(20)]
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(frame(spark, rows), 3, 85).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    assert got == groups(sets, [(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])


def test_substring_dedup(spark):
    got = sorted(rlz_dedup.substring_dedup(frame(spark), 13).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    first = {}
    for i, t in TEXTS:
        w = split(t)
        for k in range(len(w) - 12 if i is not None else 0):
            block = tuple(w[k : k + 13])
            first[block] = min(first.get(block, i), i)
    want = []
    for i, t in TEXTS:
        w = split(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got] == want
    part = {r.doc_id: r.factors for r in got}[9]
    assert [(f.start, f.n_words, f.source, f.source_start) for f in part] == [(40, 40, 1, 50)]
    assert rlz_dedup.substring_dedup(frame(spark, []), 13).count() == 0


def test_line_templates(spark):
    rows = [(k, f"Page {k} of this long book\nunique {'abcdefghijkl'[k]} line here\n\nSame footer line") for k in range(8)] + [(50, None), (51, ""), (None, "Same footer line\nmine"), (52, "Same footer line\nSame footer line"), (52, "Same footer line\nSame footer line")]
    got = line_templates.drop_templates(frame(spark, rows)).collect()
    out = {(r.doc_id, r.text) for r in got}
    assert len(got) == len(rows) and set(got[0].asDict()) == {*frame(spark).columns, "n_dropped"}
    assert (0, rows[0][1]) in out and (1, "unique b line here\n") in out
    assert {(50, None), (51, ""), (None, "mine"), (52, "")} <= out
    assert {r.n_dropped for r in got if r.doc_id == 52} == {2}
    # A field with many values is generalised if enough of the line stays.
    rows = [(k, f"The value of {x} was seen on the host") for k, x in enumerate("abcdefgh")] + [(30, "The value is of no interest to hosts"), (31, "alpha beta gamma"), (32, "1 2 3")] + [(40 + k, f"{k} {k} {k}") for k in range(9)]
    out = {r.doc_id: r.n_dropped for r in line_templates.drop_templates(frame(spark, rows)).collect()}
    assert [out[k] for k in range(8)] == [0] + [1] * 7 and out[30] == out[31] == out[32] == out[41] == 0
    assert line_templates.drop_templates(frame(spark, [])).count() == 0


def test_templates_count_documents_not_kinds_of_lines(spark):
    line = "The value of {} was seen here"
    alone = [(1, "\n".join(line.format(x) for x in "abcdef")), (2, line.format("g"))]
    assert [r.n_dropped for r in line_templates.drop_templates(frame(spark, alone)).collect()] == [0, 0]
    # A token that one document repeats stays no part of the template: six documents have the rest of the line.
    rows = [(1, "\n".join(f"Here is the {x} often told story of a man in the town of {y}" for x, y in zip("abcdef", "uvwxyz")))]
    rows += [(k, f"Here is the {x} seldom told story of a man in the town of {y}") for k, (x, y) in enumerate(zip("ghijk", "nopqr"), 2)]
    out = {r.doc_id: r.n_dropped for r in line_templates.drop_templates(frame(spark, rows)).collect()}
    assert out == {1: 0} | dict.fromkeys(range(2, 7), 1)
    out = {r.doc_id: r.n_dropped for r in line_templates.drop_templates(frame(spark, rows[:-1])).collect()}
    assert out == dict.fromkeys(range(1, 6), 0)


def test_benchmark(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (None, "other words"), (4, "..."), (5, "short ITEM")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x ONE, two-three four five six seven eight nine ten! eleven y"), (2, "a short; item. two three"), (3, None), (4, ""), (5, "one two three four five six seven eight nine"), (6, "shortitem short"), (None, "short item"), (7, "é short item é" * 3), (7, "é short item é" * 3)]
    for chars in (1 << 20, 20):  # one pass, and several
        got = decontaminate.find_benchmark(frame(spark, rows), bench, 10, chars=chars).collect()
        by = {r.doc_id: r for r in got}
        assert len(got) == len(rows)
        assert (by[1].n_words, by[1].n_hit, by[1]["items"]) == (13, 11, ["1"])
        h = by[1].hits[0]
        assert rows[0][1].encode()[h.start : h.end].decode() == "ONE, two-three four five six seven eight nine ten! eleven"
        assert (by[2].n_hit, by[2]["items"]) == (2, ["2", "5"]) and by[5].n_hit == by[6].n_hit == by[3].n_words == 0
        assert by[None].n_hit == 2
    assert decontaminate.find_benchmark(frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark(frame(spark, []), bench).count() == 0


def test_quality(spark):
    rows = TEXTS + [(100 + k, ("good plain words " if k % 2 else "BAD!! WORDS!! ") * (k % 7 + 1)) for k in range(80)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(100 + k, k % 2, "x") for k in range(80)] + [(None, 1, "x"), (1, None, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    w = quality.fit(docs, labels, ~quality.held_out(5, 0), max_rows=60)
    out = quality.score(docs, w)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in got if (r.doc_id or 0) >= 100)
    empty = quality.fit(docs, labels.limit(0), ~quality.held_out(5, 0))
    assert not empty.any() and quality.score(frame(spark, []), empty).count() == 0


def test_language(spark):
    r = random.Random(3)
    mine = {"xx": ["der", "und", "nicht", "schule"], "yy": ["the", "and", "not", "school"]}
    rows = [(k, " ".join(r.choices(mine["xx" if k % 2 else "yy"], k=12)), "xx" if k % 2 else "yy") for k in range(60)]
    rows += [(70, None, "xx"), (71, "123 ...", "yy"), (72, "", None), (None, "und nicht", None), (73, "x" * 5000, None), (74, "的 und", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, ~quality.held_out(3, 1))
    got = {x.doc_id: x for x in langid.predict(docs, model).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(60)) and got[None].lang_pred == "xx"
    assert {(got[k].lang_pred, got[k].score) for k in (70, 71, 72)} == {("und", 0.0)}
    assert 0 < got[73].score <= 1
    none = langid.fit(docs.limit(0), ~quality.held_out(3, 1))
    assert {x.lang_pred for x in langid.predict(docs, none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocabulary = langid.load_vocabulary()
    p = np.random.default_rng(1).random((len(vocabulary.lengths), 2))
    p /= p.sum(axis=0)
    ids = {}
    for w in ("▁", "▁t", "▁th", "▁the", "t", "h", "e", "th", "he", "the"):
        codes = langid._codes([w])
        ids[w] = int(vocabulary.find(langid._spans(codes, len(w))[-1][:, 0])[0])

    def total(word, lang):
        if not word:
            return 1.0
        return sum(p[ids.get(word[:k], 0) or (1 if k == 1 else 0), lang] * total(word[k:], lang) for k in range(1, len(word) + 1) if ids.get(word[:k]) or k == 1)

    got = langid.word_scores(vocabulary, langid.lifted(vocabulary, p), ["the"])
    assert np.allclose(got[0], [np.log(total("▁the", 0)), np.log(total("▁the", 1))])


def test_long_runs_of_letters_that_no_language_uses(spark):
    mine = {"xx": "der und nicht schule ", "yy": "the and not school "}
    docs = spark.createDataFrame([(k, mine[x] * 2_500, x) for k in range(30) for x in mine], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    run = "\u1200" * langid.LONGEST
    texts = [(k, f"{mine[x] * 5} {run * times}", x) for k, (x, times) in enumerate(itertools.product(mine, (1, 3)))] + [(9, run, None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, docs.schema), model).collect()}
    assert all(got[k].lang_pred == x for k, _, x in texts if x) and all(0 < r.score <= 1 for r in got.values())
    # The run is one more word: its letters, each on its own.
    v = model.vocabulary
    assert np.allclose(langid.word_scores(v, model.p, [run]), langid.word_scores(v, model.p, [""]) + langid.LONGEST * np.log(model.p[1] / langid._LIFT))


def test_expected_uses_of_long_runs():
    vocabulary = langid.load_vocabulary()
    p = np.full((len(vocabulary.lengths), 1), 1e-9)
    rows = pa.RecordBatch.from_pydict({"lang": ["xx"], "word": ["\u1200" * langid.LONGEST], "n": pa.array([2], pa.int64())})
    (out,) = langid._expected(vocabulary, langid.lifted(vocabulary, p), ["xx"])(iter([rows]))
    use = dict(zip(out.column("piece").to_pylist(), out.column("use").to_pylist()))
    assert np.isclose(use[1], 2 * langid.LONGEST) and np.isclose(sum(use.values()), 2 * langid.LONGEST + 2)


def test_packing(spark):
    r = random.Random(2)
    for _ in range(100):
        n, k = r.randint(1, 7), r.randint(1, 4)
        sizes = sorted(r.sample(range(30), n))
        counts = [r.randint(1, 9) for _ in sizes]
        cost = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(sizes, counts))
        ends = packing.boundaries(sizes, counts, k)
        assert len(ends) <= k and cost(ends) == min(cost([*s, sizes[-1]]) for m in range(min(k, n)) for s in itertools.combinations(sizes[:-1], m))
    got = packing.pack(frame(spark), longest=100, buckets=4, budget=250).collect()
    total = {}
    for x in got:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.length
        assert 0 <= x.length <= x.padded
    want = {}
    for i, t in TEXTS:
        want[i] = want.get(i, 0) + len(split(t))
    assert total == want
    batches = {}
    for x in got:
        batches.setdefault((x.bucket, x.shard, x.batch), []).append(x)
    assert all(len(b) * b[0].padded <= 250 or len(b) == 1 for b in batches.values())
    assert all(sorted(x.slot for x in b) == list(range(len(b))) for b in batches.values())
    assert packing.pack(frame(spark, [])).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>ä" + "x" * 2000
    rows = [(1, "http://a/ b\n", big), (2, None, big), (None, "u", big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "e", None), (6, "f", ""), (7, "g", "y" * 3_000_000), (8, "h", big + "z"), (8, "h", big + "z")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"))
    (tmp_path / "w" / "left-by-a-lost-task.warc.zst").write_bytes(b"not an archive")
    got = warc.read_archives(spark, str(tmp_path / "w"), manifest).collect()
    assert len(got) == len(rows) and sum(r.records for r in manifest.collect()) == len(rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_digest == hashlib.sha1(big.encode()).hexdigest()) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html[r.page_id]
    assert {r.record_type for r in got if r.page_id == 8} == {"response"}
    empty = warc.write_archives(warc.with_revisits(pages.limit(0)), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e"), empty).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(4)
    centre = r.standard_normal((6, 16))
    rows = [(int(k), (centre[k % 6] + r.standard_normal(16) * 0.05).tolist(), int(k % 2) if k % 11 else None) for k in range(80)]
    rows += [(80, None, 1), (81, [0.0] * 16, 1), (82, [float("nan")] + [1.0] * 15, 1), (83, [None] + [1.0] * 15, 1), (84, [1.0, 2.0], 1), (85, [2.0, 4.0], 1), (86, [], 1), (87, rows[1][1], 1), (88, [x * 1e150 for x in rows[1][1]], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {x.vec_id: x for x in subspace_join.linked_vectors(df).collect()}

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.sqrt(v @ v)

    units = {i: (unit(v), l) for i, v, l in rows if i is not None}
    links = [(i, j) for i, j in itertools.combinations(units, 2) if units[i][0] is not None and units[j][0] is not None and units[i][1] is not None and units[i][1] == units[j][1] and len(units[i][0]) == len(units[j][0]) and units[i][0] @ units[j][0] >= 0.98]
    want = groups(units, links)
    for i in units:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in e for e in links), want[i], want[i] == i), i
    assert got[None].component_id is None and len(links) > 100
    assert subspace_join.linked_vectors(df.limit(0)).count() == 0


def test_vectors_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "CHUNK", 4)
    r = np.random.default_rng(5)
    base = r.standard_normal(16)
    rows = [(k, (base + r.standard_normal(16) * 0.12).tolist(), 1) for k in range(60)]
    got = {x.vec_id: x for x in subspace_join.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = [(i, j) for i, j in itertools.combinations(unit, 2) if unit[i] @ unit[j] >= 0.98]
    assert {i: got[i].n_links for i in unit} == {i: sum(i in e for e in links) for i in unit}
    assert {i: got[i].component_id for i in unit} == groups(unit, links)


def test_urls(spark):
    rules = spark.createDataFrame([("good.org", "/", "allow"), ("bad.net", "/", "block"), ("good.org", "/x", "block")], "host string, path string, verdict string")
    rows = [
        (1, "http://good.org/a?q", '<a href="http://friend.io/">x</a><A HREF=\'//near.io\'>'),
        (2, "HTTP://WWW.GOOD.ORG/x1#f", None),
        (3, "http://bad.net", '<a href="/rel"><a href="mailto:x@y">'),
        (4, "https://bad.net/1", ""),
        (5, "http://farm.io/", '<a class=k href="http://bad.net/1"> <a href="http://friend.io">'),
        (6, "http://friend.io/p", "<p>"),
        (7, None, "<a href='http://bad.net/'>"),
        (8, "no host", None),
        (8, "no host", None),
        (9, "http://lonely.io?x/y", None),
        (None, "http://farm.io/2", None),
    ]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, rule string, suffix string")
    got = link_trust.filter_urls(pages, rules).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("good.org", "/a", "good.org/", "allow") and by[2] == ("www.good.org", "/x1", "good.org/x", "block")
    # bad.net without a path fits no rule; its blocked page gives the host distrust.
    assert by[3] == ("bad.net", "", None, "block") and by[4][2:] == ("bad.net/", "block")
    assert by[5][2:] == (None, "block") and by[None][3] == "block" and by[6][2:] == (None, "allow")
    assert by[7] == by[8] == ("", "", None, "allow") and by[9] == ("lonely.io", "", None, "allow")
    assert link_trust.filter_urls(pages.limit(0), rules).count() == 0
