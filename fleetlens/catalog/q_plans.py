"""Queries: plan graphs, references, checkpoints and plan accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes
from fleetlens.catalog.registry import query
from fleetlens.plans import checkpoints as cp
from fleetlens.plans import graph, refs, summary
from fleetlens.session import written
from fleetlens.sources.tables import read_sample

GRAPH = ctes("plan_nodes", "plan_edges")
STATES = ctes("plan_nodes", "plan_edges", "step_states", recursive=True)

_LAYERS = """inner_edges AS (SELECT DISTINCT e.* FROM plan_edges e JOIN plan_nodes a ON a.plan_id = e.plan_id AND a.node_id = e.from_id JOIN plan_nodes z ON z.plan_id = e.plan_id AND z.node_id = e.to_id),
 walk AS (SELECT plan_id, node_id, 0 AS layer FROM plan_nodes n WHERE NOT EXISTS (SELECT 1 FROM inner_edges e WHERE e.plan_id = n.plan_id AND e.from_id = n.node_id)
   UNION SELECT e.plan_id, e.from_id, w.layer + 1 FROM walk w JOIN inner_edges e ON e.plan_id = w.plan_id AND e.to_id = w.node_id WHERE w.layer < 64),
 reach AS (SELECT plan_id, from_id, to_id FROM inner_edges UNION SELECT r.plan_id, r.from_id, e.to_id FROM reach r JOIN inner_edges e ON e.plan_id = r.plan_id AND e.from_id = r.to_id),
 loops AS (SELECT DISTINCT plan_id, from_id AS node_id FROM reach WHERE from_id = to_id),
 stuck AS (SELECT plan_id, node_id FROM loops UNION SELECT r.plan_id, r.from_id FROM reach r JOIN loops l ON l.plan_id = r.plan_id AND l.node_id = r.to_id)"""


@query("dangling_refs_c12", f"""{GRAPH} SELECT plan_id, from_id, to_id, 'to_id' AS missing FROM plan_edges e WHERE NOT EXISTS (SELECT 1 FROM plan_nodes n WHERE n.plan_id = e.plan_id AND n.node_id = e.to_id)
    UNION ALL SELECT plan_id, from_id, to_id, 'from_id' FROM plan_edges e WHERE NOT EXISTS (SELECT 1 FROM plan_nodes n WHERE n.plan_id = e.plan_id AND n.node_id = e.from_id)""")
def dangling_refs_c12(spark, d):
    return graph.dangling_refs(b.plan_nodes(spark, d), b.plan_edges(spark, d))


@query(
    "topo_layers_h2",
    f"""{ctes("plan_nodes", "plan_edges", recursive=True)}, {_LAYERS} SELECT n.plan_id, n.node_id, CASE WHEN s.node_id IS NULL THEN w.layer END::BIGINT AS layer, s.node_id IS NOT NULL AS cycle
    FROM plan_nodes n LEFT JOIN (SELECT plan_id, node_id, max(layer) AS layer FROM walk GROUP BY ALL) w ON w.plan_id = n.plan_id AND w.node_id = n.node_id
    LEFT JOIN stuck s ON s.plan_id = n.plan_id AND s.node_id = n.node_id""",
)
def topo_layers_h2(spark, d):
    return graph.topo_layers(b.plan_nodes(spark, d), b.plan_edges(spark, d))


@query(
    "ready_steps_h3",
    f"""{STATES} SELECT plan_id, node_id FROM step_states s WHERE state = 'waiting' AND NOT EXISTS (SELECT 1 FROM plan_edges e JOIN step_states t ON t.plan_id = e.plan_id AND t.node_id = e.to_id
    WHERE e.plan_id = s.plan_id AND e.from_id = s.node_id AND t.state <> 'done')""",
)
def ready_steps_h3(spark, d):
    return graph.ready_steps(b.plan_edges(spark, d), b.step_states(spark, d))


@query(
    "skip_cascade_h4",
    f"""{STATES}, hit AS (SELECT plan_id, node_id FROM step_states WHERE state IN ('failed', 'timed_out')
      UNION SELECT s.plan_id, s.node_id FROM hit h JOIN plan_edges e ON e.plan_id = h.plan_id AND e.to_id = h.node_id JOIN step_states s ON s.plan_id = e.plan_id AND s.node_id = e.from_id AND s.state = 'waiting')
    SELECT h.plan_id, h.node_id FROM hit h JOIN step_states s ON s.plan_id = h.plan_id AND s.node_id = h.node_id WHERE s.state = 'waiting'""",
)
def skip_cascade_h4(spark, d):
    return graph.skip_cascade(b.plan_edges(spark, d), b.step_states(spark, d))


_INPUT = """CASE WHEN n > 1 THEN '{"a":' || qty || ',"src":{"$task_output":"s' || (n - 1) || '","pointer":"/v/0"},"z":[{"$task_output":"s' || (n - CASE WHEN qty % 11 = 0 THEN 2 ELSE 1 END) || '"}]}'
  WHEN qty % 13 = 0 THEN '{"$task_output":7}' ELSE '{"a":' || qty || '}' END"""
_OUTPUT = "CASE WHEN qty % 7 = 0 THEN '{\"w\":1}' ELSE '{\"v\":[' || qty || ',\"{x}\"]}' END"


def _inputs(spark, d):
    return _with_input(b.plan_nodes(spark, d))


def _with_input(n):
    i, q = F.col("n"), F.col("qty").cast("string")
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    back = i - F.when(F.col("qty") % 11 == 0, 2).otherwise(1)
    linked = F.concat(
        F.lit('{"a":'), q, F.lit(',"src":{"$task_output":"'), s(i - 1), F.lit('","pointer":"/v/0"},"z":[{"$task_output":"'), s(back), F.lit('"}]}')
    )
    text = F.when(i > 1, linked).when(F.col("qty") % 13 == 0, '{"$task_output":7}').otherwise(F.concat(F.lit('{"a":'), q, F.lit("}")))
    return n.withColumn("input", text)


@query(
    "resolve_refs_c13",
    f"""{ctes("plan_nodes")}, o AS (SELECT plan_id, node_id, n, {_OUTPUT} AS output, qty FROM plan_nodes),
    j AS (SELECT x.plan_id, x.node_id, x.n, x.qty, p.output AS po, p.qty AS pq, r.output AS ro, x.n - CASE WHEN x.qty % 11 = 0 THEN 2 ELSE 1 END AS back
      FROM plan_nodes x LEFT JOIN o p ON p.plan_id = x.plan_id AND p.n = x.n - 1 LEFT JOIN o r ON r.plan_id = x.plan_id AND r.n = x.n - CASE WHEN x.qty % 11 = 0 THEN 2 ELSE 1 END),
    k AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN po IS NULL THEN 'unknown_task' WHEN pq % 7 = 0 THEN 'pointer_miss' WHEN ro IS NULL THEN 'unknown_task' END WHEN qty % 13 = 0 THEN 'malformed_ref' END AS reason FROM j)
    SELECT plan_id, node_id, CASE WHEN reason IS NULL THEN CASE WHEN n > 1 THEN '{{"a":' || qty || ',"src":' || pq || ',"z":[' || ro || ']}}' ELSE '{{"a":' || qty || '}}' END END AS resolved_input, reason FROM k""",
)
def resolve_refs_c13(spark, d):
    # Steps and outputs are of one table, grouped once.
    nodes = _with_input(written(b.plan_nodes(spark, d).select("plan_id", "node_id", "n", "qty"), "steps"))
    output = F.when(F.col("qty") % 7 == 0, '{"w":1}').otherwise(F.concat(F.lit('{"v":['), F.col("qty").cast("string"), F.lit(',"{x}"]}')))
    return refs.resolve_refs(nodes, nodes.select("plan_id", "node_id", output.alias("output")))


@query(
    "validate_plans_h1",
    f"""{ctes("plan_nodes", "plan_edges", recursive=True)}, {_LAYERS},
    plans AS (SELECT 'p' || lpad(o_orderkey::VARCHAR, 12, '0') AS plan_id, o_totalprice AS est, CASE WHEN o_orderpriority = '1-URGENT' THEN 200000 END AS mx, CASE WHEN o_orderstatus = 'P' THEN 300000 END AS bud, o_orderstatus = 'O' AS loc FROM orders),
    caps AS (SELECT DISTINCT p_brand AS capability, replace(p_brand, 'Brand#', '')::INT % 6 = 0 AS cloud FROM part WHERE p_brand <> 'Brand#7'),
    x AS (SELECT *, {_INPUT} AS input FROM plan_nodes),
    rf AS (SELECT plan_id, node_id, 's' || (n - 1) AS ref_id FROM x WHERE n > 1 UNION SELECT plan_id, node_id, 's' || (n - 2) FROM x WHERE n > 1 AND qty % 11 = 0)
    SELECT plan_id, 'cost_exceeded' AS reason, '' AS detail FROM plans WHERE est > mx UNION ALL SELECT plan_id, 'budget_inconsistent', '' FROM plans WHERE est > bud
    UNION ALL SELECT plan_id, 'empty', '' FROM plans WHERE plan_id NOT IN (SELECT plan_id FROM plan_nodes)
    UNION ALL SELECT DISTINCT plan_id, 'dangling_edge', from_id || '>' || to_id FROM plan_edges e WHERE NOT EXISTS (SELECT 1 FROM plan_nodes n WHERE n.plan_id = e.plan_id AND n.node_id = e.to_id)
    UNION ALL SELECT DISTINCT plan_id, 'cycle', '' FROM stuck
    UNION ALL SELECT plan_id, 'unknown_capability', node_id || ':' || capability FROM x WHERE capability NOT IN (SELECT capability FROM caps)
    UNION ALL SELECT x.plan_id, 'locality_conflict', node_id || ':' || capability FROM x JOIN caps USING (capability) JOIN plans USING (plan_id) WHERE cloud AND loc
    UNION ALL SELECT plan_id, 'undeclared_output_ref', node_id || '>' || ref_id FROM rf WHERE NOT EXISTS (SELECT 1 FROM plan_edges e WHERE e.plan_id = rf.plan_id AND e.from_id = rf.node_id AND e.to_id = rf.ref_id)
    UNION ALL SELECT plan_id, 'malformed_output_ref', node_id FROM x WHERE n = 1 AND qty % 13 = 0
    UNION ALL SELECT plan_id, 'schema_violation', node_id || ':b' FROM x WHERE capability = 'Brand#3' AND n = 1 AND qty % 13 <> 0""",
)
def validate_plans_h1(spark, d):
    o = read_sample(spark, d, "orders")
    plans = o.select(
        F.concat(F.lit("p"), b.pad("o_orderkey")).alias("plan_id"),
        F.col("o_totalprice").alias("estimated_usd"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 200000.0).alias("max_cost_usd"),
        F.when(F.col("o_orderstatus") == "P", 300000.0).alias("budget_usd"),
        (F.col("o_orderstatus") == "O").alias("must_be_local"),
    )
    brands = read_sample(spark, d, "part").filter(F.col("p_brand") != "Brand#7").select(F.col("p_brand").alias("capability")).distinct()
    caps = brands.withColumn("cloud", F.regexp_replace("capability", "Brand#", "").try_cast("int") % 6 == 0)
    required = brands.filter(F.col("capability") == "Brand#3").withColumn("field", F.lit("b"))
    return graph.validate_plans(plans, _inputs(spark, d), b.plan_edges(spark, d), caps, required)


@query(
    "step_hash_h7",
    f"""{ctes("plan_nodes")} SELECT plan_id, node_id, sha256('{{"capability":"' || capability || '","input":' || to_json('{{"line":' || n || ',"qty":' || qty || '}}') || '}}') AS input_hash FROM plan_nodes""",
)
def step_hash_h7(spark, d):
    return cp.step_hashes(_hashable(spark, d))


def _hashable(spark, d):
    # Keys out of order on purpose: the hash is of the canonical form.
    n = b.plan_nodes(spark, d)
    text = F.concat(F.lit('{"qty": '), F.col("qty").cast("string"), F.lit(', "line": '), F.col("n").cast("string"), F.lit("}"))
    return n.withColumn("input", text)


_HASHED = """h AS (SELECT plan_id, node_id, qty, n, shipped, sha256('{"capability":"' || capability || '","input":' || to_json('{"line":' || n || ',"qty":' || qty || '}') || '}') AS input_hash FROM plan_nodes),
 ck AS (SELECT plan_id, node_id, CASE WHEN qty % 5 = 0 THEN sha256('stale') ELSE input_hash END AS stored, CASE WHEN qty % 7 = 0 THEN '{"broken' ELSE '{"qty":' || qty || '}' END AS output, 'task-' || n AS task_id FROM h WHERE qty % 3 > 0)"""


@query(
    "checkpoint_hits_c14",
    f"""{ctes("plan_nodes")}, {_HASHED}, s AS (SELECT h.plan_id, h.node_id, CASE WHEN stored IS NULL THEN 'miss' WHEN stored <> input_hash THEN 'changed' WHEN output = '{{"broken' THEN 'corrupt' ELSE 'hit' END AS status, task_id, output
      FROM h LEFT JOIN ck ON ck.plan_id = h.plan_id AND ck.node_id = h.node_id)
    SELECT plan_id, node_id, status, CASE WHEN status = 'hit' THEN task_id END AS task_id, CASE WHEN status = 'hit' THEN output END AS output FROM s""",
)
def checkpoint_hits_c14(spark, d):
    steps = _hashable(spark, d)
    hashed = cp.step_hashes(steps).join(steps.select("plan_id", "node_id", "qty", "n"), ["plan_id", "node_id"])
    qty = F.col("qty")
    stored = hashed.filter(qty % 3 > 0).select(
        "plan_id",
        "node_id",
        F.when(qty % 5 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.col("input_hash")).alias("input_hash"),
        F.when(qty % 7 == 0, '{"broken').otherwise(F.concat(F.lit('{"qty":'), qty.cast("string"), F.lit("}"))).alias("output"),
        F.concat(F.lit("task-"), F.col("n").cast("string")).alias("task_id"),
    )
    return cp.checkpoint_hits(hashed.select("plan_id", "node_id", "input_hash"), stored)


_CHECKS = """cks AS (SELECT 'p' || lpad(c_custkey::VARCHAR, 8, '0') AS plan_id, c_mktsegment AS node_id, TIMESTAMP '2001-01-01' + to_days((c_custkey % 400)::INT) AS created_at FROM customer),
 done AS (SELECT DISTINCT t.plan_id FROM tasks t JOIN aggregates a ON a.task_id = t.id WHERE t.capability = 'plan.execute' AND t.state = 'done'
   AND a.output->>'$.status' = 'done' AND (a.output->>'$.failed')::INT = 0),
 completed AS (SELECT DISTINCT plan_id FROM cks WHERE plan_id IN (FROM done) AND plan_id NOT IN (SELECT plan_id FROM tasks WHERE capability = 'plan.execute' AND state NOT IN ('done', 'failed', 'cancelled', 'expired')))"""


def _checks(spark, d):
    c = read_sample(spark, d, "customer")
    made = F.lit("2001-01-01").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 400).cast("int"))
    return c.select(F.concat(F.lit("p"), b.pad("c_custkey", 8)).alias("plan_id"), F.col("c_mktsegment").alias("node_id"), made.alias("created_at"))


def _completed(spark, d):
    return cp.completed_plans(_checks(spark, d), b.tasks(spark, d), b.aggregates(spark, d))


@query("completed_plans_c4", f"{ctes('tasks', 'aggregates')}, {_CHECKS} SELECT plan_id FROM completed")
def completed_plans_c4(spark, d):
    return _completed(spark, d)


@query(
    "sweep_checkpoints_h6",
    f"""{ctes('tasks', 'aggregates')}, {_CHECKS} SELECT plan_id, node_id, CASE WHEN plan_id IN (FROM completed) THEN 'completed' ELSE 'old' END AS why FROM cks
    WHERE plan_id IN (FROM completed) OR created_at < TIMESTAMP '2001-03-01'""",
)
def sweep_checkpoints_h6(spark, d):
    return cp.sweep_checkpoints(_checks(spark, d), _completed(spark, d), F.lit("2001-03-01").cast("timestamp"))


@query(
    "fanout_summary_d12",
    """WITH o AS (SELECT l_orderkey AS run_id, CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'dropped' ELSE 'ok' END WHEN l_linestatus = 'O' THEN 'failed' ELSE 'timed_out' END AS status FROM lineitem)
    SELECT o_orderkey AS run_id, count(status) AS pulled, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timed_out') AS timed_out,
    count(*) FILTER (status = 'dropped') AS dropped_in_flight, CASE WHEN o_orderpriority = '1-URGENT' THEN 'deadline_exceeded' WHEN o_orderstatus = 'F' AND count(*) FILTER (status IN ('failed', 'timed_out')) > 0 THEN 'failed_fast' ELSE 'source_drained' END AS reason
    FROM orders LEFT JOIN o ON run_id = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus""",
)
def fanout_summary_d12(spark, d):
    li = read_sample(spark, d, "lineitem")
    open_ = F.col("l_linestatus") == "O"
    status = (
        F.when(F.col("l_returnflag") == "A", "ok").when((F.col("l_returnflag") == "N") & open_, "dropped").when(F.col("l_returnflag") == "N", "ok").when(open_, "failed").otherwise("timed_out")
    )
    o = read_sample(spark, d, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("fail_fast"), (F.col("o_orderpriority") == "1-URGENT").alias("deadline_hit"))
    return summary.fanout_summary(li.select(F.col("l_orderkey").alias("run_id"), status.alias("status")), runs)


@query(
    "plan_summary_d13",
    f"""{ctes("plan_nodes", "step_states")}, pl AS (SELECT 'p' || lpad(o_orderkey::VARCHAR, 12, '0') AS plan_id, o_orderpriority = '1-URGENT' AS dl, o_orderpriority = '2-HIGH' AS ab, CASE WHEN o_orderstatus = 'P' THEN 'paused' END AS bs FROM orders),
    c AS (SELECT s.plan_id, count(*) AS total, count(*) FILTER (state = 'done') AS ok, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'timed_out') AS timed_out, 0::BIGINT AS skipped,
      count(*) FILTER (qty % 4 = 0) AS replayed, count(*) FILTER (state = 'waiting') AS unscheduled FROM step_states s JOIN plan_nodes n ON n.plan_id = s.plan_id AND n.node_id = s.node_id GROUP BY s.plan_id),
    j AS (SELECT *, ok = total OR (NOT ab AND NOT dl AND ok > 0) AS good FROM c JOIN pl USING (plan_id))
    SELECT plan_id, total, ok, failed, timed_out, skipped, replayed, unscheduled, CASE WHEN NOT good THEN 'failed' WHEN bs IS NOT NULL AND unscheduled > 0 THEN bs ELSE 'done' END AS status,
    CASE WHEN NOT good THEN CASE WHEN dl THEN 'plan deadline exceeded' WHEN ab THEN 'plan aborted (fail_fast)' ELSE 'no step succeeded' END END AS error FROM j""",
)
def plan_summary_d13(spark, d):
    nodes = b.plan_nodes(spark, d).select("plan_id", "node_id", (F.col("qty") % 4 == 0).alias("replayed"))
    steps = b.step_states(spark, d).join(nodes, ["plan_id", "node_id"])
    o = read_sample(spark, d, "orders")
    plans = o.select(
        F.concat(F.lit("p"), b.pad("o_orderkey")).alias("plan_id"),
        (F.col("o_orderpriority") == "1-URGENT").alias("deadline_hit"),
        (F.col("o_orderpriority") == "2-HIGH").alias("aborted"),
        F.when(F.col("o_orderstatus") == "P", "paused").alias("budget_stop"),
    )
    return summary.plan_summary(steps, plans)


@query(
    "resume_points_e21",
    f"""{ctes('tasks', 'aggregates')}, r AS (SELECT t.plan_id, a.output FROM tasks t JOIN aggregates a ON a.task_id = t.id WHERE t.capability = 'plan.execute'),
    c AS (SELECT plan_id, bool_or(output->>'$.status' = 'done' AND (output->>'$.failed')::INT = 0) AS complete FROM r GROUP BY plan_id),
    l AS (SELECT plan_id, unnest((output->'$.resume.in_flight')::VARCHAR[]) AS step_id, 'in_flight' AS kind FROM r UNION SELECT plan_id, unnest((output->'$.resume.unscheduled')::VARCHAR[]), 'unscheduled' FROM r
      UNION SELECT plan_id, id, 'in_flight' FROM tasks WHERE capability <> 'plan.execute' AND state NOT IN ('done', 'failed', 'cancelled', 'expired') AND plan_id IN (SELECT plan_id FROM c))
    SELECT c.plan_id, complete, step_id, kind FROM c LEFT JOIN l USING (plan_id)""",
)
def resume_points_e21(spark, d):
    return summary.resume_points(b.tasks(spark, d), b.aggregates(spark, d)).select("plan_id", "complete", "step_id", "kind")
