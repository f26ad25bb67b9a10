"""The test tables seen as canonical tables.  ``SQL`` holds the same views as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.hashing import entry_hash
from fleetlens.session import written
from fleetlens.sources.tables import read_sample, spread
from fleetlens.vocab import ZERO_HASH

SQL: dict[str, str] = {}


def ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause of the named views, in the order given."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def pad(column: str, width: int = 12) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def choose(column: str, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def sql_choose(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


ACTION = {
    "click": "task.dispatched",
    "view": "shell.allowed",
    "error": "shell.denied",
    "purchase": "cloud.escalated",
    "signup": "secret.accessed",
}
STATE = {"click": "submitted", "view": "claimed", "purchase": "running", "signup": "done", "error": "failed"}
TASK_STATE = {"O": "submitted", "P": "running", "F": "done"}


# --- contributions -------------------------------------------------------------------------------------------

SQL["contributions"] = """
SELECT strftime(ts, '%Y-%m-%d') AS request_id,
       lpad(user_id::VARCHAR, 6, '0') || '-' || lpad(event_id::VARCHAR, 10, '0') AS node_id,
       CASE WHEN event_type <> 'error' THEN 'ok' WHEN k % 2 = 0 THEN 'failed' ELSE 'timed_out' END AS status,
       k * 10 AS duration_ms,
       CASE event_type
         WHEN 'click' THEN '[{"id":' || k || ',"n":' || c || ',"score":' || c || '},{"id":' || (k + 1) || ',"n":"' || c || '","score":' || k || '}]'
         WHEN 'view' THEN '{"items":[{"id":' || k || ',"n":' || c || ',"score":' || c || '}]}'
         WHEN 'purchase' THEN '{"id":' || k || ',"n":' || c || ',"score":"' || c || '"}'
         WHEN 'signup' THEN '[{"id":"' || k || '"},{"id":null,"n":' || k || '},{"nokey":true}]' END AS output,
       CASE WHEN event_type = 'error' AND k % 10 = 0 THEN ''
            WHEN event_type = 'error' THEN 'boom ' || repeat('x', (k * 4)::INT) END AS error
FROM (SELECT *, (props->>'$.k')::BIGINT AS k, round(value * 100)::BIGINT AS c FROM events)
"""


def contributions(spark: SparkSession, d: str) -> DataFrame:
    e = spread(read_sample(spark, d, "events"))
    e = e.withColumns({"k": k_of(), "c": F.round(F.col("value") * 100).cast("long")})
    k, c = F.col("k").cast("string"), F.col("c").cast("string")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    click = text('[{"id":', k, ',"n":', c, ',"score":', c, '},{"id":', (F.col("k") + 1).cast("string"), ',"n":"', c, '","score":', k, "}]")
    view = text('{"items":[{"id":', k, ',"n":', c, ',"score":', c, "}]}")
    purchase = text('{"id":', k, ',"n":', c, ',"score":"', c, '"}')
    signup = text('[{"id":"', k, '"},{"id":null,"n":', k, '},{"nokey":true}]')
    kind = F.col("event_type")
    failed = kind == "error"
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("request_id"),
        F.concat(pad("user_id", 6), F.lit("-"), pad("event_id", 10)).alias("node_id"),
        F.when(~failed, "ok").when(F.col("k") % 2 == 0, "failed").otherwise("timed_out").alias("status"),
        (F.col("k") * 10).alias("duration_ms"),
        F.when(kind == "click", click).when(kind == "view", view).when(kind == "purchase", purchase).when(kind == "signup", signup).alias("output"),
        F.when(failed & (F.col("k") % 10 == 0), "").when(failed, F.concat(F.lit("boom "), F.expr("repeat('x', int(k * 4))"))).alias("error"),
    )


SQL["items"] = """
SELECT request_id, node_id, pos - 1 AS pos, items[pos] AS item
FROM (SELECT request_id, node_id, items, unnest(range(1, len(items) + 1)) AS pos
      FROM (SELECT request_id, node_id,
                   CASE WHEN json_type(output) = 'ARRAY' THEN json_extract(output, '$[*]')
                        WHEN json_type(output, '$.items') = 'ARRAY' THEN json_extract(output, '$.items[*]')
                        ELSE [output::JSON] END AS items
            FROM contributions WHERE status = 'ok'))
"""

# --- tasks, results, plans -----------------------------------------------------------------------------------

SQL["tasks"] = f"""
SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'plan.execute' ELSE 'shell.exec' END AS capability,
       'p' || lpad(o_custkey::VARCHAR, 8, '0') AS plan_id,
       {sql_choose("o_orderstatus", TASK_STATE)} AS state,
       'n' || (o_custkey % 5) AS issued_by,
       o_orderdate AS issued_at,
       CASE WHEN o_orderstatus <> 'O' THEN 'n' || (o_orderkey % 7) END AS assigned_node,
       o_totalprice
FROM orders
"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    o = read_sample(spark, d, "orders")
    return o.select(
        pad("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "plan.execute").otherwise("shell.exec").alias("capability"),
        F.concat(F.lit("p"), pad("o_custkey", 8)).alias("plan_id"),
        choose("o_orderstatus", TASK_STATE).alias("state"),
        F.concat(F.lit("n"), (F.col("o_custkey") % 5).cast("string")).alias("issued_by"),
        F.col("o_orderdate").alias("issued_at"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("n"), (F.col("o_orderkey") % 7).cast("string"))).alias("assigned_node"),
        "o_totalprice",
    )


SQL["results"] = """
SELECT lpad(l_orderkey::VARCHAR, 12, '0') AS task_id, l_shipdate AS completed_at,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE round(l_extendedprice * (1 - l_discount), 4) END AS cost_usd,
       '{"line":' || l_linenumber || ',"qty":' || l_quantity::BIGINT || '}' AS output
FROM lineitem
"""


def results(spark: SparkSession, d: str) -> DataFrame:
    li = read_sample(spark, d, "lineitem")
    cost = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return li.select(
        pad("l_orderkey").alias("task_id"),
        F.col("l_shipdate").alias("completed_at"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(cost).alias("cost_usd"),
        F.concat(
            F.lit('{"line":'), F.col("l_linenumber").cast("string"), F.lit(',"qty":'), F.col("l_quantity").cast("long").cast("string"), F.lit("}")
        ).alias("output"),
    )


SQL["cost_rows"] = """
SELECT r.task_id, t.capability, t.plan_id, t.issued_by, r.completed_at, r.cost_usd
FROM results r JOIN tasks t ON t.id = r.task_id WHERE r.cost_usd > 0
"""

SQL["aggregates"] = """
SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS task_id, o_orderdate AS completed_at,
       '{"plan_id":"p' || lpad(o_custkey::VARCHAR, 8, '0') || '","name":"plan ' || o_custkey || '","status":"' ||
       CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'paused' ELSE 'failed' END ||
       '","ok":' || (o_orderkey % 4) || ',"failed":' || (o_orderkey % 2) || ',"timed_out":0,"skipped":0,"budget":{"spent_usd":' ||
       (o_totalprice * 100)::BIGINT || ',"cap_usd":' || (o_custkey * 10) || ',"soft_limit_usd":' || (o_custkey * 5) ||
       ',"triggered":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END ||
       '},"resume":{"in_flight":["s' || (o_orderkey % 3) || '"],"unscheduled":["s' || (o_orderkey % 5) || '","s' || (o_orderkey % 7) || '"]}}' AS output
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
"""


def aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Results of plan runs: what each says about its plan, budget and open steps."""
    o = read_sample(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    n = lambda e: F.expr(f"cast({e} as string)")
    status = F.when(F.col("o_orderkey") % 3 == 0, "done").when(F.col("o_orderkey") % 3 == 1, "paused").otherwise("failed")
    return o.select(
        pad("o_orderkey").alias("task_id"),
        F.col("o_orderdate").alias("completed_at"),
        F.concat(
            F.lit('{"plan_id":"p'),
            pad("o_custkey", 8),
            F.lit('","name":"plan '),
            n("o_custkey"),
            F.lit('","status":"'),
            status,
            F.lit('","ok":'),
            n("o_orderkey % 4"),
            F.lit(',"failed":'),
            n("o_orderkey % 2"),
            F.lit(',"timed_out":0,"skipped":0,"budget":{"spent_usd":'),
            n("cast(round(o_totalprice * 100) as bigint)"),
            F.lit(',"cap_usd":'),
            n("o_custkey * 10"),
            F.lit(',"soft_limit_usd":'),
            n("o_custkey * 5"),
            F.lit(',"triggered":'),
            F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"),
            F.lit('},"resume":{"in_flight":["s'),
            n("o_orderkey % 3"),
            F.lit('"],"unscheduled":["s'),
            n("o_orderkey % 5"),
            F.lit('","s'),
            n("o_orderkey % 7"),
            F.lit('"]}}'),
        ).alias("output"),
    )


# --- plan graphs: lines of an order -------------------------------------------------------------------------

SQL["plan_nodes"] = """
SELECT 'p' || lpad(l_orderkey::VARCHAR, 12, '0') AS plan_id, 's' || l_linenumber AS node_id,
       min(CASE WHEN p_brand = 'Brand#7' THEN 'unlisted' ELSE p_brand END) AS capability, max(l_quantity)::BIGINT AS qty, l_linenumber AS n,
       min(l_linestatus) AS linestatus, max(l_returnflag) AS returnflag, l_orderkey, max(l_shipdate) AS shipped
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber
"""
SQL["plan_edges"] = """
SELECT 'p' || lpad(l_orderkey::VARCHAR, 12, '0') AS plan_id, 's' || l_linenumber AS from_id, 's' || (l_linenumber - 1) AS to_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE l_linenumber > 1
UNION ALL
SELECT 'p' || lpad(l_orderkey::VARCHAR, 12, '0'), 's' || l_linenumber, 's' || (l_linenumber + 1)
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 5 = 0) WHERE l_linenumber = 4
"""


def plan_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Steps: the distinct lines of an order."""
    li = read_sample(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_linestatus", "l_returnflag", "l_shipdate"
    )
    p = read_sample(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    brand = F.when(F.col("p_brand") == "Brand#7", "unlisted").otherwise(F.col("p_brand"))
    g = li.join(p, "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(brand).alias("capability"),
        F.max("l_quantity").cast("long").alias("qty"),
        F.min("l_linestatus").alias("linestatus"),
        F.max("l_returnflag").alias("returnflag"),
        F.max("l_shipdate").alias("shipped"),
    )
    return g.select(
        F.concat(F.lit("p"), pad("l_orderkey")).alias("plan_id"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("node_id"),
        "capability",
        "qty",
        F.col("l_linenumber").alias("n"),
        "linestatus",
        "returnflag",
        "l_orderkey",
        "shipped",
    )


def plan_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each step depends on the line before it; missing lines dangle, every fifth order has a cycle if it can."""
    li = read_sample(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    n = F.col("l_linenumber")
    targets = F.array(F.when(n > 1, n - 1), F.when((F.col("l_orderkey") % 5 == 0) & (n == 4), n + 1))
    return li.select(
        F.concat(F.lit("p"), pad("l_orderkey")).alias("plan_id"), s(n).alias("from_id"), F.explode(F.array_compact(targets)).alias("t")
    ).select("plan_id", "from_id", s(F.col("t")).alias("to_id"))


SQL["step_states"] = """
SELECT plan_id, node_id, CASE WHEN linestatus = 'O' THEN 'waiting' WHEN returnflag = 'R' AND qty > 30 THEN 'failed'
       WHEN returnflag = 'R' THEN 'timed_out' ELSE 'done' END AS state FROM plan_nodes
"""


def step_states(spark: SparkSession, d: str) -> DataFrame:
    n = plan_nodes(spark, d)
    late = F.col("returnflag") == "R"
    state = (
        F.when(F.col("linestatus") == "O", "waiting").when(late & (F.col("qty") > 30), "failed").when(late, "timed_out").otherwise("done")
    )
    return n.select("plan_id", "node_id", state.alias("state"))


# --- task events, heartbeats ---------------------------------------------------------------------------------

SQL["task_events"] = f"""
SELECT event_id, 't' || user_id AS task_id, {sql_choose("event_type", STATE)} AS state, ts AS at_ts,
       'n' || lpad(props->>'$.k', 3, '0') AS source, 'cap' || (user_id % 7) AS capability FROM events
"""


def task_events(spark: SparkSession, d: str) -> DataFrame:
    e = read_sample(spark, d, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"),
        choose("event_type", STATE).alias("state"),
        F.col("ts").alias("at"),
        F.concat(F.lit("n"), F.lpad(k_of().cast("string"), 3, "0")).alias("source"),
        F.concat(F.lit("cap"), (F.col("user_id") % 7).cast("string")).alias("capability"),
    )


def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    e = read_sample(spark, d, "events")
    return e.select(
        F.concat(F.lit("u"), pad("user_id", 6)).alias("node_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("value").alias("load"),
        "event_type",
        k_of().alias("k"),
    )


SQL["heartbeats"] = """
SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS node_id, event_id AS seq, ts, value AS load, event_type,
       (props->>'$.k')::BIGINT AS k FROM events
"""

SQL["manifests"] = """
SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS node_id, s_name AS hostname,
       CASE n_regionkey % 3 WHEN 0 THEN 'Linux' WHEN 1 THEN 'macOS' END AS os,
       CASE WHEN s_acctbal > 3000 THEN ['fs.search', 'shell.exec'] ELSE ['fs.search'] END AS capabilities,
       ['n' || s_nationkey, 'r' || n_regionkey] AS scopes,
       (s_suppkey % 8 + 1)::INT AS cpu_cores, (s_suppkey % 4) * 8192 AS ram_total_mb, s_acctbal, s_nationkey, n_regionkey
FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""


def manifests(spark: SparkSession, d: str) -> DataFrame:
    s = read_sample(spark, d, "supplier")
    n = read_sample(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    t = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return s.join(n, "s_nationkey").select(
        pad("s_suppkey", 6).alias("node_id"),
        F.col("s_name").alias("hostname"),
        F.when(F.col("n_regionkey") % 3 == 0, "Linux").when(F.col("n_regionkey") % 3 == 1, "macOS").alias("os"),
        F.when(F.col("s_acctbal") > 3000, F.array(F.lit("fs.search"), F.lit("shell.exec"))).otherwise(F.array(F.lit("fs.search"))).alias("capabilities"),
        F.array(t("n", "s_nationkey"), t("r", "n_regionkey")).alias("scopes"),
        (F.col("s_suppkey") % 8 + 1).cast("int").alias("cpu_cores"),
        (F.col("s_suppkey") % 4 * 8192).alias("ram_total_mb"),
        "s_acctbal",
        "s_nationkey",
        "n_regionkey",
    )


# --- documents -----------------------------------------------------------------------------------------------

SQL["docs"] = "SELECT source AS scope, source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents"


def docs(spark: SparkSession, d: str) -> DataFrame:
    t = spread(read_sample(spark, d, "documents").select("doc_id", "text", "lang", "source"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t.select(F.col("source").alias("scope"), path.alias("path"), F.col("text").alias("content"))


# Letters and digits, in the words of both engines.
SQL["tokens"] = r"""
SELECT scope, path, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS tokens FROM docs
"""
SQL["sized"] = "SELECT scope, path, tokens, len(tokens) AS dl FROM tokens"
SQL["postings"] = "SELECT scope, path, dl, term, count(*) AS tf FROM (SELECT scope, path, dl, unnest(tokens) AS term FROM sized) GROUP BY ALL"
SQL["corpus"] = "SELECT scope, count(*) AS n_docs, avg(dl) AS avgdl FROM sized GROUP BY scope"


# --- audit ---------------------------------------------------------------------------------------------------

SQL["audit"] = f"""
SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS node_id, event_id AS seq, (epoch_us(ts) // 1000) AS at_ms,
       {sql_choose("event_type", ACTION)} AS action, '/bin/x' || (props->>'$.k') AS subject,
       CASE event_type WHEN 'error' THEN '{{"suppressed_repeats":' || (props->>'$.k') || ',"distinct_subjects":3,"window_start_ms":' || (epoch_us(ts) // 1000) || '}}'
            WHEN 'view' THEN '{{"suppressed_repeats":"' || (props->>'$.k') || '"}}' ELSE props END AS detail,
       'peer:' || (user_id % 11) AS actor,
       CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) + 5000 END AS received_at_ms
FROM events
"""


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Events as audit entries without hashes."""
    e = read_sample(spark, d, "events")
    k, ms = k_of().cast("string"), F.unix_millis("ts")
    summary = F.concat(F.lit('{"suppressed_repeats":'), k, F.lit(',"distinct_subjects":3,"window_start_ms":'), ms.cast("string"), F.lit("}"))
    texty = F.concat(F.lit('{"suppressed_repeats":"'), k, F.lit('"}'))
    return e.select(
        F.concat(F.lit("u"), pad("user_id", 6)).alias("node_id"),
        F.col("event_id").alias("seq"),
        ms.alias("at_ms"),
        choose("event_type", ACTION).alias("action"),
        F.concat(F.lit("/bin/x"), k).alias("subject"),
        F.when(F.col("event_type") == "error", summary).when(F.col("event_type") == "view", texty).otherwise(F.col("props")).alias("detail"),
        F.concat(F.lit("peer:"), (F.col("user_id") % 11).cast("string")).alias("actor"),
        F.when(F.col("event_type") == "view", ms + 5000).alias("received_at_ms"),
    )


# A chain is built over every 64 consecutive events, so each is short however many events there are.
SQL["links"] = f"""
SELECT 'n' || lpad((event_id // 64)::VARCHAR, 8, '0') AS node_id, event_id % 64 + 1 AS seq, (epoch_us(ts) // 1000) AS at_ms,
       {sql_choose("event_type", ACTION)} AS action, CASE WHEN event_type <> 'view' THEN 'user ' || user_id END AS subject,
       props AS detail, 'peer:' || (user_id % 11) AS actor, event_id, event_type, (props->>'$.k')::BIGINT AS k
FROM events
"""
_SQL_HASH = """sha256('{{"action":' || to_json({a}.action) || ',"actor":' || to_json({a}.actor) || ',"at":' || {a}.at_ms || ',"detail":' ||
 coalesce(to_json({a}.detail)::VARCHAR, 'null') || ',"node":' || to_json({a}.node_id) || ',"prev":' || to_json({prev}) || ',"seq":' || {a}.seq ||
 ',"subject":' || coalesce(to_json({a}.subject)::VARCHAR, 'null') || '}}')"""


def sql_hash(alias: str, prev: str) -> str:
    return _SQL_HASH.format(a=alias, prev=prev)


SQL["chain"] = f"""
SELECT l.*, repeat('0', 64) AS prev_hash, {sql_hash("l", "repeat('0', 64)")} AS entry_hash FROM links l WHERE seq = 1
UNION ALL
SELECT l.*, c.entry_hash, {sql_hash("l", "c.entry_hash")} FROM links l JOIN chain c ON c.node_id = l.node_id AND l.seq = c.seq + 1
"""
SQL["chained"] = """
SELECT node_id, seq, at_ms, action, subject, CASE WHEN event_type = 'purchase' AND k = 0 THEN '{"k": -1}' ELSE detail END AS detail,
       actor, prev_hash, entry_hash, event_id, event_type, k
FROM chain WHERE NOT (event_type = 'view' AND k = 1)
"""


LINK = ["seq", "at_ms", "action", "subject", "detail", "actor", "event_id", "event_type", "k"]


def _folded(spark: SparkSession, d: str) -> DataFrame:
    """A row a chain: node_id and its entries in order."""
    e = read_sample(spark, d, "events")
    fields = LINK
    links = e.select(
        F.concat(F.lit("n"), F.lpad(F.expr("event_id div 64").cast("string"), 8, "0")).alias("node_id"),
        (F.col("event_id") % 64 + 1).alias("seq"),
        F.unix_millis("ts").alias("at_ms"),
        choose("event_type", ACTION).alias("action"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("subject"),
        F.col("props").alias("detail"),
        F.concat(F.lit("peer:"), (F.col("user_id") % 11).cast("string")).alias("actor"),
        "event_id",
        "event_type",
        k_of().alias("k"),
    )
    rows = links.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))

    def link(out: Column, r: Column) -> Column:
        prev = F.coalesce(F.try_element_at(out, F.lit(-1))["entry_hash"], F.lit(ZERO_HASH))
        h = entry_hash(F.col("node_id"), r["seq"], r["at_ms"], r["action"], r["subject"], r["detail"], r["actor"], prev)
        return F.concat(out, F.array(F.struct(*[r[f].alias(f) for f in fields], prev.alias("prev_hash"), h.alias("entry_hash"))))

    element = ",".join(
        f"{f}:{t}"
        for f, t in zip(
            [*fields, "prev_hash", "entry_hash"],
            ["bigint", "bigint", "string", "string", "string", "string", "bigint", "string", "bigint", "string", "string"],
        )
    )
    start = F.array().cast(f"array<struct<{element}>>")
    return rows.select("node_id", F.aggregate("rows", start, link).alias("entries"))


def chain(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).select("node_id", F.inline_outer("entries"))


def stored_chain(spark: SparkSession, d: str) -> DataFrame:
    """``chain`` from a table written once, for queries that read it more than once: a hash is 32 bytes and stored once."""
    entry = lambda r: F.struct(*[r[f].alias(f) for f in LINK], F.unhex(r["entry_hash"]).alias("hash"))
    held = written(_folded(spark, d).select("node_id", F.transform("entries", entry).alias("entries")), "links")
    text = lambda h: F.lower(F.hex(h))
    before = lambda i: F.coalesce(text(F.get("entries", i - 1)["hash"]), F.lit(ZERO_HASH)).alias("prev_hash")
    whole = lambda r, i: F.struct(*[r[f].alias(f) for f in LINK], before(i), text(r["hash"]).alias("entry_hash"))
    return held.select("node_id", F.inline_outer(F.transform("entries", whole)))


def chained(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    """The chains after tampering: one detail in some hundred edited, some rows deleted.  ``c``: the chains, if stored."""
    c = chain(spark, d) if c is None else c
    edited = F.when((F.col("event_type") == "purchase") & (F.col("k") == 0), F.lit('{"k": -1}')).otherwise(F.col("detail"))
    kept = c.filter(~((F.col("event_type") == "view") & (F.col("k") == 1)))
    return kept.withColumns({"detail": edited, "received_at_ms": F.lit(None).cast("long")})


SQL["pins"] = """
SELECT event_id AS pin_no, node_id, seq, CASE WHEN k = 7 THEN sha256('other') ELSE entry_hash END AS entry_hash,
       at_ms AS first_seen_ms, at_ms + k * 1000 AS observed_at_ms, CASE WHEN k % 10 = 3 THEN 'contradicted' ELSE 'unchecked' END AS status, k
FROM chain WHERE event_type IN ('signup', 'view')
"""


def pins(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    c = (chain(spark, d) if c is None else c).filter(F.col("event_type").isin("signup", "view"))
    return c.select(
        F.col("event_id").alias("pin_no"),
        "node_id",
        "seq",
        F.when(F.col("k") == 7, F.sha2(F.lit("other"), 256)).otherwise(F.col("entry_hash")).alias("entry_hash"),
        F.col("at_ms").alias("first_seen_ms"),
        (F.col("at_ms") + F.col("k") * 1000).alias("observed_at_ms"),
        F.when(F.col("k") % 10 == 3, "contradicted").otherwise("unchecked").alias("status"),
        "k",
    )


SQL["runs"] = """
SELECT node_id, seq AS target_seq, CASE WHEN k % 2 = 0 THEN 1 ELSE greatest(seq - 3, 1) END AS from_seq,
       CASE WHEN k % 4 = 1 THEN seq - 1 ELSE seq END AS through_seq, k % 4 <> 1 AS complete, k FROM pins
"""


def runs(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    k, seq = F.col("k"), F.col("seq")
    return pins(spark, d, c).select(
        "node_id",
        seq.alias("target_seq"),
        F.when(k % 2 == 0, F.lit(1).cast("long")).otherwise(F.greatest(seq - 3, F.lit(1))).alias("from_seq"),
        F.when(k % 4 == 1, seq - 1).otherwise(seq).alias("through_seq"),
        (k % 4 != 1).alias("complete"),
        "k",
    )


# --- conversations -------------------------------------------------------------------------------------------

SQL["messages"] = """
SELECT conv_id || '-' || turn AS message_id, conv_id * 1000 + turn AS arrival, role AS channel,
       CASE WHEN turn % 2 = 0 THEN '+' || conv_id ELSE 'whatsapp:+' || conv_id END AS sender,
       CASE WHEN turn = 5 THEN '  ' ELSE text END AS body, CASE WHEN role = 'system' THEN 'STOP' END AS opt_out_type, conv_id, turn
FROM conversations
"""
SQL["allowlist"] = "SELECT DISTINCT '+' || conv_id AS sender FROM conversations WHERE turn >= 2"


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = read_sample(spark, d, "conversations")
    number = F.concat(F.lit("+"), F.col("conv_id").cast("string"))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"),
        F.col("role").alias("channel"),
        F.when(F.col("turn") % 2 == 0, number).otherwise(F.concat(F.lit("whatsapp:"), number)).alias("sender"),
        F.when(F.col("turn") == 5, "  ").otherwise(F.col("text")).alias("body"),
        F.when(F.col("role") == "system", "STOP").alias("opt_out_type"),
        "conv_id",
        "turn",
    )


def allowlist(spark: SparkSession, d: str) -> DataFrame:
    c = read_sample(spark, d, "conversations").filter(F.col("turn") >= 2)
    return c.select(F.concat(F.lit("+"), F.col("conv_id").cast("string")).alias("sender")).distinct()
