"""Rule ledger, filter interaction audit and spelling variants: edge cases and brute force."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from fleetlens.llm import filter_audit, rule_ledger, spelling


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


LONG = " ".join(f"w{random.Random(7).randrange(10**9)}{k}" for k in range(60_000))
TEXTS = [
    (1, "one two three four five six seven eight\nx one two three four five six seven eight"),
    (2, None),
    (3, ""),
    (4, " \t\n\n "),
    (5, "a a a a a a a a a a a a a a a a a a a a a a"),
    (5, "a a a a a a a a a a a a a a a a a a a a a a"),
    (6, "line one\nline one\n\nline one\r\nline two\x0bß £ | # $ é\U0001f600"),
    (None, "fine plain words that make no trouble at all in any of the rules here so this text is kept by every policy there is"),
    (7, LONG),
    (8, "x" * 400_000),
    (9, "# $ % " * 30),
]


def frame(spark, rows=TEXTS):
    """Columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, f"s{k % 3}" if k else None, 4, "f", 7, "m", 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n_words int, failed string, mask int, key string, docs int")


def measured(text):
    w, t = words_of(text), text or ""
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(again))


def test_ledger_by_brute_force(spark):
    r = random.Random(1)
    more = [(20 + k, " ".join(r.choice("ab cd\n ef #".split(" ")) for _ in range(r.randrange(60)))) for k in range(60)]
    docs = frame(spark, TEXTS + more)
    got = rule_ledger.ledger(docs).collect()
    assert len(got) == len(TEXTS) + len(more)
    assert set(got[0].asDict()) == {*docs.columns, *rule_ledger.MEASURES}
    want = Counter((i, *measured(t)) for i, t in TEXTS + more)
    assert Counter((r.doc_id, *[r[m] for m in rule_ledger.MEASURES]) for r in got) == want
    for row in got:
        names = {n: row[n] for n in rule_ledger.MEASURES}
        assert row.failed == sum(rule_ledger.BITS[n] for n, rule in rule_ledger.RULES if eval(rule, {}, names))
    assert rule_ledger.ledger(frame(spark, [])).count() == 0


def test_policies_and_ablations_read_bits_alone(spark):
    rows = spark.createDataFrame([(b,) for b in [*range(64), 16, 16, 4, 12, 12, 0]], "failed long")
    p = rule_ledger.POLICIES[1]
    alone, together = p.mask(p.alone), p.mask(p.together)
    out = lambda b: bool(b & alone) or (b & together).bit_count() >= p.least
    assert all(r.kept_v1 is not out(r.failed) for r in rule_ledger.apply_policies(rows).collect())
    bits = [r.failed for r in rows.collect()]
    got = {r.rule: r for r in rule_ledger.ablations(rows).collect() if r.version == "v1"}
    for name, bit in rule_ledger.BITS.items():
        decided = [b for b in bits if out(b) and not out(b & ~bit)]
        r = got[name]
        assert (r.n_docs, r.n_failed, r.n_rejected, r.n_decided) == (len(bits), sum(bool(b & bit) for b in bits), sum(map(out, bits)), len(decided))
        shared = (1 << 63) - 1
        for b in decided:
            shared &= b
        assert r.shared == (shared if decided else None)
    none = rule_ledger.ablations(rows.limit(0)).collect()
    assert len(none) == 12 and all((r.n_docs, r.n_decided, r.shared) == (0, 0, None) for r in none)


def fails(text):
    t, w = text or "", words_of(text)
    return ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else "") + ("D" if set(t) & set("#$%&*|") else "")


def test_audit_by_running_every_order(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["Word", "of", "text", "#", "x" * k]) + str(r.randrange(k + 1)) for _ in range(r.choice([20, 250]))) for k in range(30)]
    rows = TEXTS + [(100 + k, r.choice(texts)) for k in range(120)] + [(110, texts[0]), (110, texts[0]), (None, texts[0])]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(100 + k, k % 2, int(k % 5 == 0), "x") for k in range(60)] + [(101, 0, 1, "x"), (None, 1, 1, "x"), (7, None, None, "x")], "doc_id long, quality int, toxic int, mask string")
    good, toxic = {i for i, q, *_ in ((x.doc_id, x.quality) for x in labels.collect()) if q == 1 and i is not None}, {x.doc_id for x in labels.collect() if x.toxic == 1 and x.doc_id is not None}
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    table = [(x.source or "", fails(x.text) + ("E" if x.doc_id is not None and first[x.text or ""] < x.doc_id else ""), x.doc_id) for x in docs.collect()]
    want = {}
    for part in {p for p, *_ in table}:
        own = [(f, i) for p, f, i in table if p == part]
        share = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(f, i) for f, i in left if letter in f]
                left = [(f, i) for f, i in left if letter not in f]
                share[letter] += len(gone)
                want[part, order, step] = [len(left), len(gone), sum(letter in f for f, _ in own) - len(gone), sum(f == letter for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), letter]
        for (p, _, _), row in want.items():
            if p == part:
                row[-1] = share[row[-1]]
    got = filter_audit.filter_interactions(docs, labels).collect()
    assert len(got) == len(want) == 3 * 600 + (600 if any(p == "" for p, *_ in table) else 0)
    for x in got:
        assert [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] == want[x.part, x.filter_order, x.step]
    assert filter_audit.filter_interactions(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_interactions(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_intervals_cover_every_order_once():
    """Each set of failures is removed exactly once in each order."""
    hit = Counter()
    for mask, _, rank, sign in filter_audit.intervals():
        hit[mask, rank] += sign
    for mask in range(1, 32):
        sums = list(itertools.accumulate(hit[mask, k] for k in range(121)))
        assert sums == [1] * 120 + [0]


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        others = [v for v in n if v != w and near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 2 * n[w] else None, n[w], len(others)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row += [root, out[row[0]][1] if row[0] else None]
    return out


def word_rows():
    r = random.Random(11)
    stems = ["".join(r.choice("abcdé") for _ in range(r.randrange(4, 9))) for _ in range(40)]
    rows = [(None, None), (1, None), (2, ""), (3, "123 -- ..."), (4, ("q" * 70_000 + " ") * 3 + ("q" * 70_001 + " ") * 9), (None, "ABCDE abcde ÀÉÎÕÜ " * 4), (5, "abcd÷ " * 3 + "abcde×"), (6, "letter " * 50 + "lettér " * 20 + "lettrr " * 3 + "lettr " * 7)]
    for i, w in ((7, "chain"), (8, "flôwer")):
        rows.append((i, " ".join([w] * 60 + [w + "x"] * 27 + [w + "xy"] * 12 + ["z" + w + "xy"] * 5)))
    for k in range(300):
        edits = []
        for _ in range(30):
            w = list(r.choice(stems))
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = r.choice(["", "a", "b", "é", "X"])
            edits.append("".join(w))
        rows.append((10 + k, " ".join(edits)))
    return rows + [rows[-1], rows[-1]]


@pytest.mark.parametrize("sample,cell", [(1 << 16, 1 << 13), (40, 6), (1 << 16, 8)])
def test_variants_by_brute_force(spark, sample, cell):
    """Whatever the cells: one for each length, a few fitted on a sample, and cells of a few vectors."""
    rows = word_rows()
    docs = spark.createDataFrame([(*x, "a", 2, "w", "f") for x in rows], "doc_id long, text string, letters string, n int, word string, form string")
    got = {x.word: [x.form, x.n, x.n_near, x.root, x.form_n] for x in spelling.spelling_variants(docs, sample=sample, cell=cell).collect()}
    assert got == variants(rows) and sum(v[2] for v in got.values()) > 300
    assert sum(v[0] is not None and v[3] != v[0] for v in got.values()) >= 4
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.where("doc_id < 5 and doc_id <> 4")).count() == 0


def test_anagrams_share_one_vector(spark):
    """Words of equal letters are not near; each finds the words one letter away through one vector."""
    text = " ".join(["".join(p) for p in itertools.permutations("abcde")] * 3 + ["abcdf"] * 9 + ["abcdeg"] * 3)
    got = {x.word: (x.n_near, x.form) for x in spelling.spelling_variants(spark.createDataFrame([(None, text)], "doc_id long, text string")).collect()}
    assert len(got) == 122 and sum(n for n, _ in got.values()) == 4
    assert got["abcde"] == (2, "abcdf") and got["abcdeg"] == (1, None) and got["edcba"] == (0, None)


def test_line_sql_counts_documents(spark):
    """Where one document has six kinds of a line, the operator and its SQL both see one document."""
    import duckdb
    from pyspark.sql import functions as F

    from fleetlens.llm import line_templates
    from fleetlens.llm.queries import OP2_SQL

    line = "The value of {} was seen here"
    rows = [(1, "\n".join(line.format(x) for x in "abcdef")), (2, line.format("g")), (3, "Same old footer line\nown words")]
    rows += [(10 + k, f"Same old footer line\nsome {k} other\nHere is the {x} told story of a man in the town") for k, x in enumerate("abcdefg")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = got.select("doc_id", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(OP2_SQL).fetchall())
    assert {r.doc_id: r.n_dropped for r in got}[2] == 0 and max(r.n_dropped for r in got) == 2
