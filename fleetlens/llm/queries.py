"""The queries of this subpackage and, where SQL can state them, the same results as DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, filter_audit, langid, line_templates, link_trust, minhash_forest, packing, quality, rlz_dedup, rule_ledger, spelling, subspace_join, warc
from fleetlens.llm.common import shared_folder, table


def op1_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out(5, 0)
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    out = quality.score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_templates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
split AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM doc),
flat AS (SELECT doc_id, line, pos, trim(regexp_replace(line, '[ \t\r\x0B\x0C]+', ' ', 'g'), ' ') AS f FROM split),
lines AS (SELECT doc_id, line, pos, regexp_replace(f, '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g') AS masked FROM flat),
held AS (SELECT DISTINCT doc_id, masked FROM lines WHERE masked <> ''),
kinds AS (SELECT masked, min(doc_id) AS first_doc, string_split(masked, ' ') AS t FROM held GROUP BY masked),
leafed AS (SELECT *, len(t) AS size, array_to_string(list_slice(t, 1, 3), ' ') AS head FROM kinds),
placed AS (SELECT size, head, masked, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM leafed),
frequent AS (SELECT size, head, pos, token FROM placed JOIN held USING (masked) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 6),
shaped AS (
  SELECT masked, string_agg(CASE WHEN p.pos <= 3 OR f.token IS NOT NULL THEN p.token ELSE '<*>' END, ' ' ORDER BY p.pos) AS template
  FROM placed p LEFT JOIN frequent f USING (size, head, pos, token) GROUP BY masked),
recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM shaped JOIN held USING (masked) GROUP BY template
  HAVING count(DISTINCT doc_id) >= 6 AND len(list_filter(string_split(template, ' '), lambda x: x <> '<*>')) >= 0.7 * len(string_split(template, ' '))),
marked AS (
  SELECT doc_id, pos, line, coalesce(first_doc <> doc_id, false) AS gone
  FROM lines LEFT JOIN (SELECT masked, first_doc FROM shaped JOIN recurring USING (template)) USING (masked)),
made AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_dropped, 0)::INTEGER AS n_dropped, CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM doc LEFT JOIN made USING (doc_id)
"""


def op3_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words),
blocks AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS block FROM starts),
first_of AS (SELECT block, min(doc_id) AS first_doc FROM blocks GROUP BY block),
covered AS (SELECT DISTINCT doc_id, i + k AS pos FROM blocks JOIN first_of USING (block), range(0, 13) AS r(k) WHERE first_doc < doc_id),
spread AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM spread ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op4_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
pattern AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS p FROM item_at),
sizes AS (SELECT DISTINCT size FROM pattern),
doc_at AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size),
hit AS (SELECT doc_id, i, d.size, item_id FROM (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS p FROM doc_at) d JOIN pattern USING (size, p)),
words_hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 10) AS r(k) WHERE k < size GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


def op5_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH page AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS keep FROM page WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keep <> page_id OR page_id IS NULL THEN keep END AS refers_to
FROM page LEFT JOIN last USING (payload_digest)
"""


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.linked_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low USING (vec_id) LEFT JOIN many USING (vec_id)
"""


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM doc WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
link AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN size USING (doc_id)
"""


#: Fixed values: the rules that the query is asked to apply.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op9_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return link_trust.filter_urls(table(spark, sf_dir, "pages"), rules)


def _op9_sql() -> str:
    rules = ", ".join(str(r) for r in URL_RULES)
    return rf"""
WITH RECURSIVE rules(suffix, start, verdict) AS (VALUES {rules}),
raw AS (SELECT page_id, url, html, strpos(url, '://') AS p FROM pages),
cut AS (SELECT page_id, html, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS u FROM raw),
page AS (SELECT page_id, html, lower(regexp_extract(u, '^([^/?#]*)', 1)) AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
place AS (SELECT host, path, count(*) AS pages FROM page GROUP BY ALL),
best AS (
  SELECT host, path, arg_max(suffix || start, (length(suffix || start), suffix || start, verdict)) AS rule, arg_max(verdict, (length(suffix || start), suffix || start, verdict)) AS verdict
  FROM place JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY host, path),
ruled AS (SELECT place.*, rule, verdict FROM place LEFT JOIN best USING (host, path)),
kinds(verdict, kind) AS (VALUES ('allow', 'trust'), ('block', 'distrust')),
seeds AS (SELECT kind, host, sum(pages) / sum(sum(pages)) OVER (PARTITION BY kind) AS seed FROM ruled JOIN kinds USING (verdict) GROUP BY kind, host),
link AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a[ 	

][^>]*?href[ 	

]*=[ 	

]*["'']?([^"'' 	

>]+)', 1)) AS l FROM page WHERE host <> ''),
target AS (SELECT src, CASE WHEN starts_with(l, '//') THEN lower(regexp_extract(l, '^//([^/?#]*)', 1)) WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(l, '://([^/?#]*)', 1))
  WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE src END AS dst FROM link),
edge AS (SELECT src, dst, count(*) AS n FROM target WHERE dst <> '' GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edge UNION ALL SELECT 'distrust', dst, src, n FROM edge),
flow AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
paths(k, kind, host, rank) AS (SELECT 0, kind, host, seed FROM seeds UNION ALL SELECT k + 1, kind, dst, {link_trust.DAMPING} * sum(share * rank)
  FROM paths JOIN (SELECT kind, src AS host, dst, share FROM flow) USING (kind, host) WHERE k < {link_trust.most_rounds()} GROUP BY k, kind, dst),
ranks AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM (SELECT kind, host, CASE WHEN k < {link_trust.most_rounds()} THEN 1 - {link_trust.DAMPING} ELSE 1 END * rank AS rank FROM paths) GROUP BY host)
SELECT page_id, page.host, page.path, rule, coalesce(verdict, CASE WHEN distrust > {link_trust.THRESHOLD * (1 + link_trust.TOLERANCE)} * trust THEN 'block' ELSE 'allow' END) AS verdict
FROM page JOIN ruled USING (host, path) LEFT JOIN ranks USING (host)
"""


def op10_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out(3, 1)
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.apply_policies(rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("kept_base")).alias("base_failed"), F.col("kept_v1").alias("kept"), "failed")


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM words),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS block FROM starts),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, block) >= 2),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS kinds FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - kinds, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN line_counts USING (doc_id)),
judged AS (
  SELECT *, (n_words < 20)::BIGINT AS r0, (100 * n_repeat_words > 30 * n_words)::BIGINT AS r1, (word_chars < 3 * n_words)::BIGINT AS r2, (word_chars > 10 * n_words)::BIGINT AS r3,
    (10 * n_symbols > n_words)::BIGINT AS r4, (100 * n_dup_lines > 30 * n_lines)::BIGINT AS r5 FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 + r1 > 0 AS base_failed, r0 + r1 + r4 = 0 AND r2 + r3 + r5 < 2 AS kept,
  r0 + 2 * r1 + 4 * r2 + 8 * r3 + 16 * r4 + 32 * r5 AS failed
FROM judged
"""


def op12_lehmer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH text_of AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM text_of LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM judged GROUP BY part, fails),
letter(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
fate AS (SELECT part, o, fails, n, good, toxic, list_min([strpos(o, f) FOR f IN string_split(fails, '') IF f <> '']) AS gone FROM counts, orders),
steps AS (
  SELECT part, o AS filter_order, s AS step, substr(o, s, 1) AS f, sum(n) FILTER (WHERE gone IS NULL OR gone > s) AS kept, sum(n) FILTER (WHERE gone = s) AS removed,
    sum(n) FILTER (WHERE gone < s AND contains(fails, substr(o, s, 1))) AS redundant, sum(n) FILTER (WHERE fails = substr(o, s, 1)) AS unique_fails,
    sum(good) FILTER (WHERE gone = s) AS good_lost, sum(toxic) FILTER (WHERE gone = s) AS toxic_lost
  FROM fate, range(1, 6) AS r(s) GROUP BY part, o, s)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM steps
"""


def op13_letter_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE crc_step(k, v, turn) AS (
  SELECT k, k::BIGINT, 0 FROM range(0, 256) AS r(k)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, turn + 1 FROM crc_step WHERE turn < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY k) AS c FROM crc_step WHERE turn = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(doc_id || ':' || run)), '..')]),
    lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]))) AS h
  FROM kinds, crc_table),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one AS (SELECT DISTINCT a.word AS word, b.word AS other FROM holes a JOIN words b ON a.rest = b.word),
near AS (
  SELECT word, other FROM one UNION SELECT other, word FROM one
  UNION SELECT a.word, b.word FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, encode(other))) AS other, max(o.n) AS other_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain(word, here) AS (SELECT word, word FROM words UNION ALL SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = chain.here WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.here AS root FROM chain JOIN formed f ON f.word = chain.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN ends USING (word)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_ftrl": op1_quality_ftrl,
    "op2_line_templates": op2_line_templates,
    "op3_rlz_dedup": op3_rlz_dedup,
    "op4_aho_corasick": op4_aho_corasick,
    "op5_warc_dictionary": op5_warc_dictionary,
    "op6_length_buckets": op6_length_buckets,
    "op7_subspace_join": op7_subspace_join,
    "op8_minhash_forest": op8_minhash_forest,
    "op9_link_trust": op9_link_trust,
    "op10_segmentation_langid": op10_segmentation_langid,
    "op11_rule_ledger": op11_rule_ledger,
    "op12_lehmer_audit": op12_lehmer_audit,
    "op13_letter_trees": op13_letter_trees,
}

ORACLES: dict[str, str] = {
    "op2_line_templates": OP2_SQL,
    "op3_rlz_dedup": OP3_SQL,
    "op4_aho_corasick": OP4_SQL,
    "op5_warc_dictionary": OP5_SQL,
    "op7_subspace_join": OP7_SQL,
    "op8_minhash_forest": OP8_SQL,
    "op9_link_trust": _op9_sql(),
    "op11_rule_ledger": OP11_SQL,
    "op12_lehmer_audit": OP12_SQL,
    "op13_letter_trees": OP13_SQL,
}
