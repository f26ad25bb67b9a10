"""Queries whose inputs cross an edge: large plans, repeated hints, missing times, late batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fleetlens.catalog import bindings as b
from fleetlens.catalog.q_corpus import INDEX, _search_sql
from fleetlens.catalog.q_costs import _LIMITS, _PLANS, _STEP_ID, _plans
from fleetlens.catalog.q_io import _folder
from fleetlens.catalog.q_merge import _SCORED, ITEMS
from fleetlens.catalog.q_placement import _GOALS, _REQUESTS, _requests, _trust
from fleetlens.catalog.registry import query
from fleetlens.operators import costs, merge, rules, search, telemetry
from fleetlens.plans import graph
from fleetlens.session import written
from fleetlens.sources import upsert
from fleetlens.sources.tables import read_sample

# A plan is all lines of a customer, far beyond 64 steps; step n waits for step n div 2.
_HEAP = """heap AS (SELECT o_custkey AS cust, 'p' || o_custkey AS plan_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _heap(spark, d):
    li = read_sample(spark, d, "lineitem").join(read_sample(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    numbered = written(li.select("o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(*order)).alias("n")), "numbered")
    step = lambda c: F.concat(F.lit("s"), c.cast("string"))
    nodes = numbered.select("o_custkey", "n", F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("plan_id"), step(F.col("n")).alias("node_id"))
    # In every fifth plan the first step also waits for the second, so that all of it is behind a cycle.
    waits = F.array_compact(F.array(F.when(F.col("n") > 1, F.floor(F.col("n") / 2)), F.when((F.col("n") == 1) & (F.col("o_custkey") % 5 == 0), F.lit(2))))
    edges = nodes.select("plan_id", F.col("node_id").alias("from_id"), F.explode(waits).alias("w")).select("plan_id", "from_id", step(F.col("w")).alias("to_id"))
    return nodes, edges


@query(
    "topo_layers_heap_h2",
    f"""WITH {_HEAP}, sized AS (SELECT *, max(n) OVER (PARTITION BY cust) AS last FROM heap)
    SELECT plan_id, 's' || n AS node_id, CASE WHEN cust % 5 <> 0 OR last < 2 THEN floor(log2(n))::BIGINT END AS layer, cust % 5 = 0 AND last >= 2 AS cycle FROM sized""",
)
def topo_layers_heap_h2(spark, d):
    nodes, edges = _heap(spark, d)
    return graph.topo_layers(nodes, edges)


@query(
    "skip_cascade_heap_h4",
    f"""WITH {_HEAP} SELECT plan_id, 's' || n AS node_id FROM heap WHERE n > 3 AND n >> (floor(log2(n))::INT - 1) = 3 AND n <> 13 AND n >> 1 <> 13 AND n >> 2 <> 13 AND n >> 3 <> 13 AND n >> 4 <> 13""",
)
def skip_cascade_heap_h4(spark, d):
    """The third step failed; the thirteenth is done already, so nothing below it is reached."""
    nodes, edges = _heap(spark, d)
    state = F.when(F.col("n") == 3, "failed").when(F.col("n") == 13, "done").otherwise("waiting")
    return graph.skip_cascade(edges, nodes.select("plan_id", "node_id", state.alias("state")))


@query("validate_plans_heap_h1", f"""WITH {_HEAP}, sized AS (SELECT plan_id, cust, count(*) AS steps FROM heap GROUP BY ALL)
    SELECT plan_id, 'too_large' AS reason, steps::VARCHAR AS detail FROM sized WHERE steps > 40 UNION ALL SELECT plan_id, 'cycle', '' FROM sized WHERE cust % 5 = 0 AND steps >= 2""")
def validate_plans_heap_h1(spark, d):
    nodes, edges = _heap(spark, d)
    nodes = nodes.select("plan_id", "node_id", F.concat(F.lit("c"), (F.col("n") % 3).cast("string")).alias("capability"), F.lit("{}").alias("input"))
    number = F.lit(None).cast("double")
    plans = nodes.select("plan_id").distinct().select("plan_id", number.alias("estimated_usd"), number.alias("max_cost_usd"), number.alias("budget_usd"), F.lit(False).alias("must_be_local"))
    caps = nodes.select("capability", F.lit(False).alias("cloud")).distinct()
    found = graph.validate_plans(plans, nodes, edges, caps, max_steps=40)
    # The steps hold no references, so each dependency is merely declared; what is left are the reasons of the graph.
    return found.filter(F.col("reason").isin("too_large", "cycle"))


@query(
    "search_case_f3",
    f"{INDEX}, {_search_sql('''term IN ('the', 'of')''', 2)} SELECT scope, path, round(score, 6) AS score FROM hits",
)
def search_case_f3(spark, d):
    """Terms that differ in case only, or that hold two words, ask for the words of the text."""
    hits = search.search(search.build_index(b.docs(spark, d)), ["The", "the", "OF-the"], "all", limit=None)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "search_many_f3",
    f"{INDEX}, {_search_sql('''term IN ('the', 'und', 'la', 'que')''', None)} SELECT scope, path, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, scope, path LIMIT 500",
)
def search_many_f3(spark, d):
    hits = search.search(search.build_index(b.docs(spark, d)), ["the", "und", "la", "que"], "any", limit=500)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "merge_concat_all_d1",
    f"""{ITEMS} SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY node_id, pos) AS item_no, node_id, pos, item::VARCHAR AS item FROM items""",
)
def merge_concat_all_d1(spark, d):
    out = merge.merge_concat(b.contributions(spark, d))
    return out.withColumns({"pos": F.col("pos").cast("long"), "item": F.to_json("item")})


@query(
    "gate_cost_hints_b10",
    """SELECT l_orderkey AS task_id, l_linenumber, p_brand AS capability, CASE WHEN paid THEN l_extendedprice END AS cost_usd
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_brand, bool_or(p_size % 10 = 0) AS paid FROM part GROUP BY p_brand) USING (p_brand)""",
)
def gate_cost_hints_b10(spark, d):
    """Every node has its own hint for a capability; one that says paid is enough, and no result is doubled."""
    part = read_sample(spark, d, "part").select("p_partkey", F.col("p_brand").alias("capability"), "p_size")
    results = read_sample(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    results = results.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", "capability", F.col("l_extendedprice").alias("cost_usd"))
    hints = part.select("capability", F.when(F.col("p_size") % 10 == 0, "cloud_paid").otherwise("free").alias("cost_hint"))
    return costs.gate_cost(results, hints).select("task_id", "l_linenumber", "capability", "cost_usd")


@query("resolve_trust_twice_c18", f"WITH {_REQUESTS} SELECT request_id, kind, from_node, CASE WHEN kind = 'shell' AND from_node = 'u4' THEN 'untrusted' ELSE trust END AS trust FROM tr")
def resolve_trust_twice_c18(spark, d):
    """Entries come twice, and one node has two levels, of which the stricter holds."""
    table = _trust(spark)
    more = table.filter("kind = 'shell' and node = 'u4'").withColumn("level", F.lit("untrusted"))
    twice = table.unionByName(table).unionByName(more)
    return rules.resolve_trust(_requests(spark, d), twice).select("request_id", "kind", "from_node", "trust")


@query(
    "dedup_deliveries_batch_g10",
    """WITH m AS (SELECT conv_id // 10 AS arrival, CASE WHEN turn = 1 THEN '' WHEN turn <> 2 THEN 'm' || (conv_id // 10) || '-' || turn END AS message_id FROM conversations)
    SELECT message_id, min(arrival) AS arrival FROM m WHERE message_id <> '' GROUP BY message_id UNION ALL SELECT message_id, arrival FROM m WHERE coalesce(message_id, '') = ''""",
)
def dedup_deliveries_batch_g10(spark, d):
    """Several messages without an id share an arrival; all of them are kept."""
    c = read_sample(spark, d, "conversations").withColumn("arrival", F.expr("conv_id div 10"))
    key = F.concat(F.lit("m"), F.col("arrival").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return telemetry.dedup_deliveries(c.select(F.when(F.col("turn") == 1, "").when(F.col("turn") != 2, key).alias("message_id"), "arrival"))


@query(
    "budget_verdicts_untimed_e1",
    f"""WITH {_PLANS}, {_LIMITS},
    steps AS (SELECT DISTINCT 'p' || lpad(l_orderkey::VARCHAR, 12, '0') AS plan_id, {_STEP_ID} AS step_id, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END AS settled_at, l_extendedprice::DECIMAL(18,6) AS cost FROM lineitem),
    running AS (SELECT *, sum(cost) OVER (PARTITION BY plan_id ORDER BY settled_at NULLS FIRST, step_id ROWS UNBOUNDED PRECEDING) AS s FROM steps),
    j AS (SELECT r.plan_id, step_id, s::DOUBLE AS spent, (s - cost)::DOUBLE AS before, cap_usd, soft_usd FROM running r JOIN limits USING (plan_id)),
    v AS (SELECT *, CASE WHEN spent > cap_usd AND before <= cap_usd THEN 'exceeded'
      WHEN NOT coalesce(spent > cap_usd, false) AND spent > soft_usd AND before <= soft_usd THEN 'soft_crossed' END AS verdict FROM j)
    SELECT plan_id, step_id, verdict, spent, round(CASE WHEN verdict = 'exceeded' THEN cap_usd ELSE soft_usd END, 6) AS limit_usd FROM v WHERE verdict IS NOT NULL""",
)
def budget_verdicts_untimed_e1(spark, d):
    """Steps without a time count before all others of their plan."""
    li = read_sample(spark, d, "lineitem")
    parts = ["l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")]
    step = F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    steps = li.select(
        F.concat(F.lit("p"), b.pad("l_orderkey")).alias("plan_id"),
        step.alias("step_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("settled_at"),
        F.col("l_extendedprice").alias("cost_usd"),
    )
    out = costs.budget_verdicts(steps, costs.effective_budget(_plans(spark, d), 25000.0, 30000.0), distinct=True)
    return out.withColumn("limit_usd", F.round("limit_usd", 6))


@query(
    "upsert_late_batch_a7",
    "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)
def upsert_late_batch_a7(spark, d):
    """Newer events are stored first; the older ones that come after replace nothing."""
    folder = f"{_folder(spark)}/table"
    e = read_sample(spark, d, "events").select("user_id", "event_id", "event_type")
    for batch in (e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0"), e.filter("event_id % 2 = 0")):
        upsert.upsert(batch, folder, ["user_id"], ["event_id"], buckets=8)
    return upsert.read_upserted(spark, folder)


# Every request has its own policy and strategy, by the leading hexadecimal digits of a hash of its id.
_POLICIES = """pol AS (SELECT request_id, ['wait', 'fail_fast', 'return_partial'][h % 3 + 1] AS policy, ['concat', 'dedupe', 'top_k'][h % 5 % 3 + 1] AS strategy, 3 + h % 7 AS k
  FROM (SELECT request_id, ('0x' || substr(sha256(request_id::VARCHAR), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT request_id FROM contributions)))"""


@query(
    "merge_requests_d6",
    f"""{ITEMS}, {_SCORED}, {_POLICIES},
    st AS (SELECT request_id, strategy, k, CASE WHEN policy = 'return_partial' AND ok = 0 OR policy <> 'return_partial' AND ok < nodes THEN 'failed' ELSE 'merged' END AS outcome
      FROM (SELECT request_id, count(*) AS nodes, count(*) FILTER (status = 'ok') AS ok FROM contributions GROUP BY request_id) JOIN pol USING (request_id)),
    it AS (SELECT s.*, json_extract(item, '$.id')::VARCHAR AS key_text, strategy, k FROM scored s JOIN st USING (request_id) WHERE outcome = 'merged'),
    dd AS (SELECT *, row_number() OVER (PARTITION BY request_id, strategy, key_text ORDER BY node_id, pos) AS r FROM it),
    kept AS (SELECT * FROM dd WHERE strategy <> 'dedupe' OR r = 1 OR key_text IS NULL),
    no AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN strategy = 'top_k' THEN -score END, node_id, pos) AS item_no FROM kept)
    SELECT request_id, outcome, st.strategy, item_no, node_id, pos, item::VARCHAR AS item FROM st LEFT JOIN (SELECT request_id, item_no, node_id, pos, item FROM no WHERE strategy <> 'top_k' OR item_no <= k) USING (request_id)""",
)
def merge_requests_d6(spark, d):
    c = b.contributions(spark, d)
    h = F.conv(F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 6), 16, 10).cast("long")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    strategy = pick(("concat", "dedupe", "top_k"), h % 5 % 3)
    policies = c.select("request_id").distinct().select(
        "request_id",
        pick(("wait", "fail_fast", "return_partial"), h % 3).alias("policy"),
        strategy.alias("strategy"),
        F.when(strategy == "dedupe", "id").otherwise("score").alias("field"),
        (3 + h % 7).cast("int").alias("k"),
    )
    return merge.merge_requests(c, policies).withColumns({"pos": F.col("pos").cast("long"), "item": F.to_json("item")})


@query(
    "route_by_table_c19",
    rf"""WITH {_GOALS}, t AS (SELECT id, regexp_replace(text, '^\s+', '') AS goal FROM g),
    p AS (SELECT *, CASE WHEN starts_with(goal, 'search: Th') THEN 1 WHEN starts_with(goal, 'search:') THEN 2 WHEN starts_with(goal, 'fetch:') THEN 3 WHEN starts_with(goal, 'Run') THEN 4 END AS route FROM t)
    SELECT id, CASE route WHEN 1 THEN 'matched' WHEN 2 THEN 'no_match' WHEN 3 THEN 'matched_but_unsupported' WHEN 4 THEN 'matched' ELSE 'no_match' END AS outcome,
      CASE route WHEN 1 THEN 'search: Th' WHEN 3 THEN 'fetch:' WHEN 4 THEN 'Run' END AS prefix, CASE route WHEN 1 THEN 'find' WHEN 3 THEN 'get' WHEN 4 THEN 'go' END AS capability,
      CASE route WHEN 1 THEN regexp_replace(goal[11:], '^\s+|\s+$', '', 'g') WHEN 4 THEN regexp_replace(goal[4:], '^\s+|\s+$', '', 'g') END AS body FROM p""",
)
def route_by_table_c19(spark, d):
    """Routes of a table: overlapping prefixes, one that emits nothing, one that nobody offers."""
    c = read_sample(spark, d, "conversations")
    lead = {0: "  run: ", 1: "shell:", 2: "search: ", 3: "fetch:", 4: "Run:", 5: "summarize:"}
    prefix = F.lit("")
    for n, text in lead.items():
        prefix = F.when(F.col("turn") % 8 == n, text).otherwise(prefix)
    texts = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(prefix, F.col("text"), F.lit(" ")).alias("text"))
    routes = spark.createDataFrame(
        [(1, "search: Th", "find", True), (2, "search:", "find", False), (3, "fetch:", "get", True), (4, "Run", "go", True)],
        "route_no int, prefix string, capability string, emits boolean",
    )
    return rules.route_by_prefix(texts, spark.createDataFrame([("find",), ("go",), ("other",)], "capability string"), routes)
