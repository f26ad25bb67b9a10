"""Queries: corpora, search and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes, pad
from fleetlens.catalog.q_merge import _CUT, _PATHS, _page_paths
from fleetlens.catalog.registry import query
from fleetlens.functions.text import truncate_bytes
from fleetlens.operators import corpus, positional, search
from fleetlens.session import new_folder
from fleetlens.sources.tables import read_sample

DOCS = ctes("docs")
INDEX = ctes("docs", "tokens", "sized", "postings", "corpus")
# The language folder comes right below the scope.
PATTERN = "qu[ei]r|[Tt]hation"

_LINES = """lines AS (SELECT scope, path, n AS line_number, regexp_replace(parts[n], '\\r$', '') AS line FROM (
  SELECT scope, path, parts, unnest(range(1, len(parts) + 1)) AS n FROM (
    SELECT scope, path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS parts FROM docs WHERE content <> '')))"""


@query(
    "grep_b1",
    f"""{DOCS}, {_LINES} SELECT scope, path, line_number, {_CUT.format(c="line", n=512, low=128)} AS line, strlen(line) > 512 AS line_truncated
    FROM lines WHERE regexp_matches(line, '{PATTERN}')""",
)
def grep_b1(spark, d):
    return corpus.grep(b.docs(spark, d), PATTERN).withColumn("line_number", F.col("line_number").cast("long"))


@query(
    "grep_literal_b1",
    f"""{DOCS}, {_LINES} SELECT scope, path, line_number, {_CUT.format(c="line", n=512, low=128)} AS line, strlen(line) > 512 AS line_truncated
    FROM lines WHERE contains(lower(line), 'the was') AND path LIKE '%1.txt' ORDER BY string_split(path, '/'), line_number LIMIT 1000""",
)
def grep_literal_b1(spark, d):
    out = corpus.grep(b.docs(spark, d), "THE was", literal=True, ignore_case=True, file_glob="*1.txt", max_results=1000)
    return out.withColumn("line_number", F.col("line_number").cast("long"))


@query(
    "grep_stats_b2",
    f"""{DOCS}, {_LINES}, m AS (SELECT scope, count(*) AS matches FROM lines WHERE regexp_matches(line, '{PATTERN}') GROUP BY scope)
    SELECT scope, count(*) FILTER (strlen(content) <= 8388608) AS files_scanned, 0::BIGINT AS skipped_binary, count(*) FILTER (strlen(content) > 8388608) AS skipped_too_large,
    coalesce(any_value(matches), 0) AS matches, coalesce(any_value(matches), 0) >= 10 AS truncated FROM docs LEFT JOIN m USING (scope) GROUP BY scope""",
)
def grep_stats_b2(spark, d):
    return corpus.grep_stats(b.docs(spark, d), PATTERN, max_results=10)


@query(
    "glob_filter_b3",
    f"""WITH p AS ({_PATHS.replace("SELECT ", "SELECT page_id, ", 1)})
    SELECT 'name' AS kind, page_id, path FROM p WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^[^/]*\\.html$')
    UNION ALL SELECT 'path', page_id, path FROM p WHERE regexp_matches(path, '^[^/]*\\.example\\.[^/][^/][^/]/en/.*$')""",
)
def glob_filter_b3(spark, d):
    p = _page_paths(spark, d).select("page_id", "path")
    by_name = corpus.glob_filter(p, "path", "*.html").withColumn("kind", F.lit("name"))
    return by_name.unionByName(corpus.glob_filter(p, "path", "*.example.???/en/**").withColumn("kind", F.lit("path")))


@query(
    "classify_files_b4",
    f"{DOCS} SELECT scope, path, strlen(content) AS size_bytes, contains(content[1:8192], chr(0)) AS binary, strlen(content) > 2000 AS too_large FROM docs",
)
def classify_files_b4(spark, d):
    return corpus.classify_files(b.docs(spark, d), 2000)


@query("build_index_f1", f"{INDEX} SELECT scope, path, dl, term, tf FROM postings")
def build_index_f1(spark, d):
    return search.build_index(b.docs(spark, d)).postings


@query("corpus_stats_f1", f"{INDEX} SELECT scope, n_docs, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats_f1(spark, d):
    return search.build_index(b.docs(spark, d)).corpus.withColumn("avgdl", F.round("avgdl", 6))


_VERSIONS = """n AS (SELECT scope, path, sha256(CASE WHEN length(content) % 5 = 0 THEN content || '!' ELSE content END) AS v FROM docs WHERE length(content) % 7 <> 1),
 o AS (SELECT scope, path, sha256(content) AS v FROM docs WHERE length(content) % 7 <> 2)"""


@query(
    "index_diff_f2",
    f"""{DOCS}, {_VERSIONS} SELECT coalesce(n.scope, o.scope) AS scope, coalesce(n.path, o.path) AS path,
    CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN n.v = o.v THEN 'unchanged' ELSE 'updated' END AS change
    FROM n FULL JOIN o ON n.scope = o.scope AND n.path = o.path""",
)
def index_diff_f2(spark, d):
    t = b.docs(spark, d)
    size = F.char_length("content")
    edited = F.when(size % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    new = t.filter(size % 7 != 1).select("scope", "path", F.sha2(edited, 256).alias("version"))
    old = t.filter(size % 7 != 2).select("scope", "path", F.sha2("content", 256).alias("version"))
    return search.index_diff(new, old)


_BM25 = "greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _search_sql(match: str, n_terms: int | None, banned: str = "", q: str = "term") -> str:
    deny = f"WHERE NOT EXISTS (SELECT 1 FROM postings x WHERE x.scope = p.scope AND x.path = p.path AND x.term IN ({banned}))" if banned else ""
    having = f"HAVING count(*) = {n_terms}" if n_terms else ""
    return f"""p AS (SELECT scope, path, dl, {q} AS q, sum(tf)::BIGINT AS tf FROM postings WHERE {match} GROUP BY ALL),
     f AS (SELECT scope, q, count(*) AS df FROM p GROUP BY ALL),
     hits AS (SELECT p.scope, p.path, sum({_BM25}) AS score FROM p JOIN f USING (scope, q) JOIN corpus c ON c.scope = p.scope {deny} GROUP BY p.scope, p.path {having})"""


@query(
    "search_all_f3",
    f"{INDEX}, {_search_sql(chr(10) + ' term IN (' + chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'of' + chr(39) + ')', 2, chr(39) + 'are' + chr(39))} SELECT scope, path, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, scope, path LIMIT 100",
)
def search_all_f3(spark, d):
    hits = search.search(search.build_index(b.docs(spark, d)), ["the", "of"], "all", ["are"], limit=100)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "search_any_f3",
    f"{INDEX}, {_search_sql('''term IN ('queri', 'les', 'und', 'los')''', None)} SELECT scope, path, round(score, 6) AS score FROM hits",
)
def search_any_f3(spark, d):
    hits = search.search(search.build_index(b.docs(spark, d)), ["queri", "les", "und", "los"], "any", limit=None)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "search_prefix_f3",
    f"{INDEX}, {_search_sql('''starts_with(term, 'than')''', 1, q=chr(39) + 'than' + chr(39))} SELECT scope, path, round(score, 6) AS score FROM hits",
)
def search_prefix_f3(spark, d):
    hits = search.search(search.build_index(b.docs(spark, d)), ["than"], prefix=True, limit=None)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "search_phrase_f4",
    f"""{INDEX}, c AS (SELECT scope, path, dl, len(list_filter(range(1, dl), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the')) AS tf FROM sized),
    f AS (SELECT scope, count(*) AS df FROM c WHERE tf > 0 GROUP BY scope)
    SELECT scope, path, tf AS occurrences, round({_BM25}, 6) AS score FROM c JOIN f USING (scope) JOIN corpus USING (scope) WHERE tf > 0""",
)
def search_phrase_f4(spark, d):
    return search.search_phrase(b.docs(spark, d), "of the", limit=None).withColumn("score", F.round("score", 6))


def _stored(spark, d):
    """An index of all documents in the shared folder, read back from there."""
    folder = new_folder(spark, "index")
    positional.refresh(b.docs(spark, d).withColumn("version", F.sha2("content", 256)), folder)
    return positional.open_index(spark, folder)


@query(
    "search_stored_f3",
    f"{INDEX}, {_search_sql('''term IN ('the', 'und', 'los')''', None, repr('que'))} SELECT scope, path, round(score, 6) AS score FROM hits",
)
def search_stored_f3(spark, d):
    """Ranked search of a stored index: the scan reads the buckets of its four words only."""
    hits = search.search(_stored(spark, d), ["the", "und", "los"], "any", ["que"], limit=None)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "search_phrase_stored_f4",
    f"""{INDEX}, c AS (SELECT scope, path, dl, len(list_filter(range(1, dl - 1), lambda i: tokens[i] = 'of' AND tokens[i + 1] = 'the' AND tokens[i + 2] = 'of')) AS tf FROM sized),
    f AS (SELECT scope, count(*) AS df FROM c WHERE tf > 0 GROUP BY scope)
    SELECT scope, path, tf AS occurrences, round({_BM25}, 6) AS score FROM c JOIN f USING (scope) JOIN corpus USING (scope) WHERE tf > 0""",
)
def search_phrase_stored_f4(spark, d):
    """A phrase with a repeated word, from the positions of a stored index."""
    return positional.search_phrase_index(_stored(spark, d), "Of the OF", limit=None).withColumn("score", F.round("score", 6))


_EDITED = f"""WITH was AS ({b.SQL["docs"]}), docs AS (SELECT scope, path, CASE WHEN length(content) % 5 = 0 THEN content || ' zebra the zebra' ELSE content END AS content
    FROM was WHERE length(content) % 7 <> 1), tokens AS ({b.SQL["tokens"]}), sized AS ({b.SQL["sized"]})"""


def _refreshed(spark, d):
    """An index of some documents, brought to another state of the corpus by one more segment."""
    folder, t = new_folder(spark, "index"), b.docs(spark, d)
    size = F.char_length("content")
    edited = F.when(size % 5 == 0, F.concat("content", F.lit(" zebra the zebra"))).otherwise(F.col("content"))
    for state in (t.filter(size % 7 != 2), t.filter(size % 7 != 1).withColumn("content", edited)):
        positional.refresh(state.withColumn("version", F.sha2("content", 256)), folder)
    return folder


@query(
    "refresh_index_f2",
    f"""{_EDITED}, w AS (SELECT scope, path, dl, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM sized)
    SELECT scope, path, dl, term, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM w GROUP BY ALL""",
)
def refresh_index_f2(spark, d):
    """A refresh equals a rebuild, position by position."""
    live = positional.open_index(spark, _refreshed(spark, d)).postings
    return live.select("scope", "path", "dl", "term", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(
    "merge_segments_f2",
    f"""{_EDITED} SELECT scope, count(*) AS n_docs, round(avg(dl), 6) AS avgdl, sum(len(list_distinct(tokens)))::BIGINT AS n_postings FROM sized GROUP BY scope""",
)
def merge_segments_f2(spark, d):
    """Statistics kept by difference, and the postings of the one segment that a merge leaves."""
    folder = _refreshed(spark, d)
    positional.merge_segments(spark, folder)
    index = positional.open_index(spark, folder)
    held = index.postings.groupBy("scope").agg(F.count("*").alias("n_postings"))
    return index.corpus.join(held, "scope", "left").select("scope", "n_docs", F.round("avgdl", 6).alias("avgdl"), F.coalesce("n_postings", F.lit(0)).alias("n_postings"))


@query(
    "snippet_f5",
    f"""{DOCS}, w AS (SELECT scope, path, list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '') AS words FROM docs),
    h AS (SELECT *, list_transform(words, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g') IN ('the', 'les')) AS hit FROM w),
    p AS (SELECT *, greatest(1, least(list_position(hit, true) - 4, len(words) - 11)) AS s FROM h WHERE list_contains(hit, true))
    SELECT scope, path, CASE WHEN s > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(range(s, least(s + 12, len(words) + 1)),
      lambda i: CASE WHEN hit[i] THEN '[' || words[i] || ']' ELSE words[i] END), ' ') || CASE WHEN s + 12 <= len(words) THEN ' …' ELSE '' END AS snippet FROM p""",
)
def snippet_f5(spark, d):
    t = b.docs(spark, d)
    # Whitespace-separated words, as the snippet sees them.
    bare = F.transform(F.split("content", r"\s+"), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    return search.snippet(t.filter(F.exists(bare, lambda w: w.isin("the", "les"))), ["the", "les"]).select("scope", "path", "snippet")


_HITS = f"{INDEX}, {_search_sql('''term IN ('the', 'les', 'und', 'los')''', None)}"


def _hits(spark, d):
    hits = search.search(search.build_index(b.docs(spark, d)), ["the", "les", "und", "los"], "any", limit=None)
    return hits.select(F.concat(F.lit("node-"), F.substring("scope", 4, 1)).alias("node_id"), "scope", "path", "score")


@query(
    "federated_search_f6",
    f"{_HITS} SELECT 'node-' || substr(scope, 4, 1) AS node_id, scope, path, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, node_id, scope, path LIMIT 50",
)
def federated_search_f6(spark, d):
    return search.federated_search(_hits(spark, d), 50).withColumn("score", F.round("score", 6))


@query(
    "federated_grep_f7",
    f"""{DOCS}, {_LINES}, m AS (SELECT scope, path, line_number, row_number() OVER (PARTITION BY scope ORDER BY string_split(path, '/'), line_number) AS match_no
    FROM lines WHERE regexp_matches(line, '{PATTERN}')) SELECT 'node-' || substr(scope, 4, 1) AS node_id, scope, path, line_number, match_no FROM m WHERE match_no <= 20""",
)
def federated_grep_f7(spark, d):
    found = corpus.grep(b.docs(spark, d), PATTERN).withColumn("node_id", F.concat(F.lit("node-"), F.substring("scope", 4, 1)))
    out = search.federated_grep(found, 20)
    return out.select("node_id", "scope", "path", F.col("line_number").cast("long").alias("line_number"), F.col("match_no").cast("long").alias("match_no"))


_NODE = "'node-' || substr(scope, 4, 1)"
# Scopes answer by their number: every fifth fails, every seventh is silent; the rest are asked and answer.
_ASKED = f"""pairs AS (SELECT DISTINCT {_NODE} AS node_id, scope, substr(scope, 4)::INT AS no FROM docs),
    asked AS (SELECT * FROM pairs ORDER BY (node_id <> 'node-2'), node_id, scope LIMIT 15),
    judged AS (SELECT *, CASE WHEN no % 7 = 4 THEN 'no answer' WHEN no % 5 = 3 THEN 'timed out' END AS error FROM asked),
    counts AS (SELECT count(*) FILTER (error IS NULL) AS targets_ok, count(*) FILTER (error IS NOT NULL) AS targets_failed, (SELECT greatest(count(*) - 15, 0) FROM pairs) AS truncated_targets FROM judged)"""


def _fan_out(spark, d):
    """Who is asked, own node first, and what they answer."""
    docs = b.docs(spark, d).select(F.concat(F.lit("node-"), F.substring("scope", 4, 1)).alias("node_id"), "scope").distinct()
    manifests = docs.groupBy("node_id").agg(F.collect_set("scope").alias("scopes"), F.array(F.lit("fs.grep")).alias("capabilities"))
    targets = search.fanout_pairs(manifests, docs.select("node_id").distinct(), "fs.grep", "node-2", 15)
    no = F.substring("scope", 4, 9).cast("int")
    answers = docs.filter(no % 7 != 4).select("node_id", "scope", F.when(no % 5 == 3, "timed out").alias("error"))
    return targets, answers


@query(
    "federated_grep_report_f7",
    f"""{DOCS}, {_LINES}, {_ASKED}, m AS (SELECT scope, path, line_number, row_number() OVER (PARTITION BY scope ORDER BY string_split(path, '/'), line_number) AS match_no FROM lines WHERE regexp_matches(line, '{PATTERN}'))
    SELECT 'result' AS kind, {_NODE} AS node_id, scope, path, line_number, match_no, NULL AS error, NULL::BIGINT AS targets_ok, NULL::BIGINT AS targets_failed, NULL::BIGINT AS truncated_targets
      FROM m WHERE match_no <= 20 AND scope IN (SELECT scope FROM judged WHERE error IS NULL)
    UNION ALL SELECT 'failure', node_id, scope, NULL, NULL, NULL, error, NULL, NULL, NULL FROM judged WHERE error IS NOT NULL
    UNION ALL SELECT 'provenance', NULL, NULL, NULL, NULL, NULL, NULL, targets_ok, targets_failed, truncated_targets FROM counts""",
)
def federated_grep_report_f7(spark, d):
    """Matches beside the scopes that failed or kept silent, and how many of each there were."""
    found = corpus.grep(b.docs(spark, d), PATTERN).withColumn("node_id", F.concat(F.lit("node-"), F.substring("scope", 4, 1)))
    best = search.federated_grep(found, 20).select("node_id", "scope", "path", F.col("line_number").cast("long").alias("line_number"), F.col("match_no").cast("long").alias("match_no"))
    return search.with_provenance(best, *_fan_out(spark, d))


@query(
    "federated_search_report_f6",
    f"""{_HITS}, {_ASKED} SELECT 'result' AS kind, {_NODE} AS node_id, scope, path, round(score, 6) AS score, NULL AS error, NULL::BIGINT AS targets_ok, NULL::BIGINT AS targets_failed, NULL::BIGINT AS truncated_targets
      FROM hits WHERE scope IN (SELECT scope FROM judged WHERE error IS NULL)
    UNION ALL SELECT 'failure', node_id, scope, NULL, NULL, error, NULL, NULL, NULL FROM judged WHERE error IS NOT NULL
    UNION ALL SELECT 'provenance', NULL, NULL, NULL, NULL, NULL, targets_ok, targets_failed, truncated_targets FROM counts""",
)
def federated_search_report_f6(spark, d):
    return search.with_provenance(_hits(spark, d).withColumn("score", F.round("score", 6)), *_fan_out(spark, d))


@query(
    "fanout_pairs_f8",
    f"""{ctes("manifests")}, p AS (SELECT node_id, unnest(scopes) AS scope FROM manifests WHERE list_contains(capabilities, 'shell.exec')
      AND node_id IN (SELECT lpad(l_suppkey::VARCHAR, 6, '0') FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-10-01'))
    SELECT node_id, scope, (SELECT greatest(count(*) - 64, 0) FROM p) AS truncated_targets FROM p ORDER BY (node_id <> '000009'), node_id, scope LIMIT 64""",
)
def fanout_pairs_f8(spark, d):
    li = read_sample(spark, d, "lineitem").filter(F.col("l_shipdate") > F.lit("2001-10-01").cast("timestamp"))
    live = li.select(pad("l_suppkey", 6).alias("node_id")).distinct()
    return search.fanout_pairs(b.manifests(spark, d), live, "shell.exec", "000009")


@query(
    "find_file_k1",
    f"""{DOCS} SELECT content_hash, first.scope AS scope, first.path AS path, copies FROM (
    SELECT sha256(content) AS content_hash, min({{'scope': scope, 'path': path}}) AS first, count(*) AS copies FROM docs WHERE path LIKE '%.txt' GROUP BY 1)""",
)
def find_file_k1(spark, d):
    return search.find_file(b.docs(spark, d), "*.txt")


@query(
    "embed_lookup_k2",
    """WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings),
    c AS (SELECT label, i, avg(e) AS e FROM x GROUP BY label, i),
    s AS (SELECT c.label, x.vec_id, sum(c.e * x.e) AS score FROM c JOIN x USING (i) GROUP BY ALL)
    SELECT label::VARCHAR AS query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
)
def embed_lookup_k2(spark, d):
    """The vectors nearest to the mean vector of every label."""
    v = read_sample(spark, d, "embeddings")
    flat = v.select("label", F.posexplode("embedding").alias("i", "e"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("e"))
    centroids = means.groupBy(F.col("label").cast("string").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("embedding")
    )
    out = search.embed_lookup(v.select("vec_id", "embedding"), centroids, 10)
    return out.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query("truncate_bytes_s1", f"{DOCS} SELECT path, {_CUT.format(c='content', n=77, low=19)} AS head FROM docs")
def truncate_bytes_s1(spark, d):
    return b.docs(spark, d).select("path", truncate_bytes(F.col("content"), 77).alias("head"))
