"""Queries: sources, merging and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes
from fleetlens.catalog.registry import query
from fleetlens.operators import corpus, merge, setops
from fleetlens.session import checkpoint_dir
from fleetlens.sources import export
from fleetlens.sources.tables import SAMPLE, read_sample, read_table

TABLES = [*SAMPLE, "benchmark", "labels"]
SCHEMAS = {**SAMPLE, "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int"}
CONTRIB = ctes("contributions")
ITEMS = ctes("contributions", "items")


@query(
    "table_counts_a1",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
)
def table_counts(spark, d):
    counts = [
        read_table(spark, d, t, SCHEMAS[t]).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        for t in TABLES
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "read_corpus_a2",
    """SELECT 'docs' AS scope, source AS folder, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content_hash, sum(strlen(text) + 1)::BIGINT AS size_bytes
    FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source""",
)
def read_corpus_a2(spark, d):
    """The documents written as one text file a source, and read back as a corpus."""
    from fleetlens.sources.corpus import read_corpus

    folder = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-{uuid.uuid4().hex}"
    docs = read_sample(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", "text", "source")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("text", "source").write.partitionBy("source").text(folder)
    files = read_corpus(spark, folder, "*.txt", scope="docs")
    return files.select("scope", F.regexp_extract("path", "source=([^/]*)/", 1).alias("folder"), F.sha2("content", 256).alias("content_hash"), "size_bytes")


_PATHS = "SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, strlen(html) AS size FROM pages"


def _page_paths(spark, d):
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return read_sample(spark, d, "pages").select(bare.alias("path"), F.octet_length("html").cast("long").alias("size"), "url", "page_id")


@query(
    "list_inventory_a3",
    f"""WITH p AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, size FROM ({_PATHS})),
    e AS (SELECT parts, size, unnest(range(1, least(len(parts), 8) + 1)) AS depth FROM p)
    SELECT array_to_string(parts[1:depth], '/') AS entry, depth, CASE WHEN max(depth = len(parts)) THEN 'file' ELSE 'dir' END AS kind,
           max(CASE WHEN depth = len(parts) THEN size END) AS size_bytes, false AS truncated
    FROM e GROUP BY 1, 2""",
)
def list_inventory_a3(spark, d):
    out = corpus.list_inventory(_page_paths(spark, d), max_depth=8, max_entries=None)
    return out.withColumn("depth", F.col("depth").cast("long"))


_CUT = """CASE WHEN strlen({c}) <= {n} THEN {c} ELSE left({c}, list_max(list_filter(range({low}, {n} + 1), lambda i: strlen(left({c}, i::BIGINT)) <= {n}))::BIGINT) END"""


@query(
    "preview_a4",
    f"""{ctes("docs")} SELECT scope, path, strlen(content) AS size_bytes, 'utf8' AS encoding,
    {_CUT.format(c="content", n=600, low=150)} AS content, strlen(content) > 600 AS truncated FROM docs""",
)
def preview_a4(spark, d):
    return corpus.preview(b.docs(spark, d), max_bytes=600)


@query(
    "preview_base64_a4",
    f"""{ctes("docs")} SELECT scope, path, strlen(content) AS size_bytes, 'base64' AS encoding,
    base64(encode(content)) AS content, false AS truncated FROM docs""",
)
def preview_base64_a4(spark, d):
    return corpus.preview(b.docs(spark, d), encoding="base64")


_CSV_SUBJECT = "CASE event_type WHEN 'error' THEN '=cmd|' || subject WHEN 'view' THEN '-' || subject WHEN 'click' THEN '@' || subject ELSE subject END"


@query(
    "csv_cells_a5",
    f"""{ctes("audit")} SELECT strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d %H:%M:%S') AS at_utc, node_id AS node, seq::VARCHAR AS seq,
    action, actor, CASE action WHEN 'shell.denied' THEN '''=cmd|' || subject WHEN 'shell.allowed' THEN '''-' || subject
    WHEN 'task.dispatched' THEN '''@' || subject ELSE subject END AS subject, detail, '' AS entry_hash FROM audit""",
)
def csv_cells_a5(spark, d):
    a = b.audit(spark, d)
    risky = {"shell.denied": "=cmd|", "shell.allowed": "-", "task.dispatched": "@"}
    lead = F.coalesce(b.choose("action", risky), F.lit(""))
    return export.csv_cells(a.withColumns({"subject": F.concat(lead, F.col("subject")), "entry_hash": F.lit(None).cast("string")}))


@query("unwrap_items_b13", f"{ITEMS} SELECT request_id, node_id, pos, item::VARCHAR AS item FROM items")
def unwrap_items_b13(spark, d):
    items = merge.unwrap_items(b.contributions(spark, d))
    return items.select("request_id", "node_id", F.col("pos").cast("long").alias("pos"), F.to_json("item").alias("item"))


@query(
    "merge_concat_d1",
    f"""{ITEMS} SELECT request_id, item_no, node_id, pos, item::VARCHAR AS item FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY node_id, pos) AS item_no FROM items) WHERE item_no <= 200""",
)
def merge_concat_d1(spark, d):
    out = merge.merge_concat(b.contributions(spark, d), cap=200)
    return out.withColumns({"pos": F.col("pos").cast("long"), "item": F.to_json("item")})


@query(
    "merge_accounting_d1",
    f"""{ITEMS} SELECT request_id, count(*) AS contributed, least(count(*), 200) AS surfaced, greatest(count(*) - 200, 0) AS truncated
    FROM items GROUP BY request_id""",
)
def merge_accounting_d1(spark, d):
    return merge.merge_accounting(b.contributions(spark, d), cap=200)


@query(
    "merge_dedupe_d2",
    f"""{ITEMS}, keyed AS (SELECT *, json_extract(item, '$.id')::VARCHAR AS key_text FROM items)
    SELECT request_id, key_text, node_id, pos, item::VARCHAR AS item FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id, key_text ORDER BY node_id, pos) AS r FROM keyed)
    WHERE r = 1 OR key_text IS NULL""",
)
def merge_dedupe_d2(spark, d):
    out = merge.merge_dedupe(merge.unwrap_items(b.contributions(spark, d)), "id")
    return out.withColumns({"pos": F.col("pos").cast("long"), "item": F.to_json("item")})


_SCORED = """scored AS (SELECT *, CASE WHEN json_type(item, '$.score') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract(item, '$.score')::DOUBLE
 ELSE 0.0 END AS score FROM items)"""


@query(
    "merge_top_k_d3",
    f"""{ITEMS}, {_SCORED} SELECT request_id, node_id, pos, item::VARCHAR AS item, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, node_id, pos) AS rank FROM scored) WHERE rank <= 25""",
)
def merge_top_k_d3(spark, d):
    out = merge.merge_top_k(merge.unwrap_items(b.contributions(spark, d)), 25)
    return out.withColumns({"pos": F.col("pos").cast("long"), "item": F.to_json("item"), "rank": F.col("rank").cast("long")})


@query(
    "merge_rerank_d4",
    f"""{ITEMS}, scored AS (SELECT *, CASE WHEN json_type(item, '$.n') IN ('UBIGINT', 'BIGINT') THEN -(json_extract(item, '$.n')::DOUBLE) ELSE 0.0 END AS score FROM items)
    SELECT request_id, node_id, pos, item::VARCHAR AS item, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, node_id, pos) AS rank FROM scored) WHERE rank <= 10""",
)
def merge_rerank_d4(spark, d):
    from fleetlens.functions.jsonfn import number_at

    out = merge.merge_rerank(merge.unwrap_items(b.contributions(spark, d)), 10, lambda item: -number_at(item, "$.n"))
    return out.withColumns({"pos": F.col("pos").cast("long"), "item": F.to_json("item"), "rank": F.col("rank").cast("long")})


_NUM = """num AS (SELECT request_id, CASE WHEN json_type(item, '$.n') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract(item, '$.n')::DOUBLE END AS n FROM items)"""


@query(
    "merge_aggregate_d5",
    f"""{ITEMS}, {_NUM} """
    + " UNION ALL ".join(
        f"SELECT '{op}' AS op, request_id, {expr} AS value, count(n) AS count, NULL::VARCHAR AS reason FROM num GROUP BY request_id"
        for op, expr in {
            "sum": "coalesce(sum(n), 0)::DOUBLE",
            "min": "min(n)",
            "max": "max(n)",
            "mean": "round(avg(n), 6)",
            "count": "count(n)::DOUBLE",
        }.items()
    )
    + " UNION ALL SELECT 'missing', request_id, NULL, 0, 'aggregate field ''absent'' missing or non-numeric in every item' FROM num GROUP BY request_id",
)
def merge_aggregate_d5(spark, d):
    items = merge.unwrap_items(b.contributions(spark, d))
    numbers = merge.merge_aggregate(items, ["sum", "min", "max", "mean", "count"], "n")
    absent = merge.merge_aggregate(items, "min", "absent").withColumn("op", F.lit("missing"))
    return numbers.unionByName(absent).withColumn("value", F.round("value", 6))


@query(
    "settle_d6",
    f"{CONTRIB} "
    + " UNION ALL ".join(
        f"SELECT '{p}' AS policy, request_id, count(*) AS nodes, count(*) FILTER (status = 'ok') AS ok, CASE WHEN {bad} THEN 'failed' ELSE 'merged' END AS outcome FROM contributions GROUP BY request_id"
        for p, bad in {
            "wait": "count(*) FILTER (status = 'ok') < count(*)",
            "return_partial": "count(*) FILTER (status = 'ok') = 0",
        }.items()
    ),
)
def settle_d6(spark, d):
    c = b.contributions(spark, d)
    both = [merge.settle(c, p).withColumn("policy", F.lit(p)) for p in ("wait", "return_partial")]
    return both[0].unionByName(both[1])


@query(
    "provenance_d7",
    f"""{ITEMS} SELECT c.request_id, c.node_id, c.status, c.duration_ms, coalesce(i.n, 0) AS item_count FROM contributions c
    LEFT JOIN (SELECT request_id, node_id, count(*) AS n FROM items GROUP BY ALL) i USING (request_id, node_id)
    UNION ALL SELECT DISTINCT request_id, 'paused-1', 'skipped', 0, 0 FROM contributions""",
)
def provenance_d7(spark, d):
    c = b.contributions(spark, d)
    excluded = c.select("request_id").distinct().withColumn("node_id", F.lit("paused-1"))
    return merge.provenance(c, excluded)


@query(
    "failure_summary_d8",
    f"""{CONTRIB}, n AS (SELECT request_id, count(*) AS nodes, count(*) FILTER (status = 'ok') AS ok FROM contributions GROUP BY request_id),
    bad AS (SELECT request_id, node_id, CASE WHEN coalesce(error, '') = '' THEN status WHEN length(error) <= 160 THEN error
              ELSE left(error, 160) || '…' END AS said, row_number() OVER (PARTITION BY request_id ORDER BY node_id) AS r
            FROM contributions WHERE status <> 'ok'),
    msg AS (SELECT request_id, string_agg('; ' || node_id || ': ' || said, '' ORDER BY r) AS errors FROM bad WHERE r <= 5 GROUP BY request_id)
    SELECT n.request_id, ok, nodes, 'federated wait: ' || ok || '/' || nodes || ' nodes ok' || errors ||
      CASE WHEN nodes - ok > 5 THEN '; …and ' || (nodes - ok - 5) || ' more' ELSE '' END AS message
    FROM n JOIN msg USING (request_id) WHERE ok < nodes""",
)
def failure_summary_d8(spark, d):
    return merge.failure_summary(b.contributions(spark, d), "wait")


@query(
    "union_results_i1",
    "SELECT event_id, user_id, value, 0 AS source_no FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, NULL, 1 FROM events WHERE event_type <> 'click'",
)
def union_results_i1(spark, d):
    e = read_sample(spark, d, "events")
    clicks = e.filter(F.col("event_type") == "click").select("event_id", "user_id", "value")
    return setops.union_results(clicks, e.filter(F.col("event_type") != "click").select("event_id", "user_id"))


@query("union_distinct_i2", "SELECT user_id, event_type FROM events UNION SELECT user_id, event_type FROM events WHERE value > 100")
def union_distinct_i2(spark, d):
    e = read_sample(spark, d, "events")
    return setops.union_distinct(e.select("user_id", "event_type"), e.filter(F.col("value") > 100).select("user_id", "event_type"))


@query(
    "never_dispatched_i4",
    f"""{ctes("plan_nodes", "step_states")} SELECT n.plan_id, n.node_id AS step_id FROM plan_nodes n
    WHERE NOT EXISTS (SELECT 1 FROM step_states s WHERE s.plan_id = n.plan_id AND s.node_id = n.node_id AND s.state <> 'waiting')""",
)
def never_dispatched_i4(spark, d):
    steps = b.plan_nodes(spark, d).select("plan_id", F.col("node_id").alias("step_id"))
    rows = b.step_states(spark, d).filter(F.col("state") != "waiting").select("plan_id", F.col("node_id").alias("step_id"))
    return setops.never_dispatched(steps, rows)
