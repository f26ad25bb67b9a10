"""Queries: placement, rules, routing and intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes, pad
from fleetlens.catalog.registry import query
from fleetlens.operators import placement as pl
from fleetlens.operators import rules as ru
from fleetlens.sources.tables import read_sample

MANIFESTS = ctes("manifests")


@query(
    "filter_nodes_b5",
    f"{MANIFESTS} SELECT node_id, hostname, os FROM manifests WHERE list_contains(capabilities, 'shell.exec') AND contains(lower(hostname), 'r#0000') AND contains(lower(coalesce(os, '')), 'ma')",
)
def filter_nodes_b5(spark, d):
    return pl.filter_nodes(b.manifests(spark, d), "cap:shell.exec node:R#0000 os:MA").select("node_id", "hostname", "os")


@query(
    "live_candidates_c5",
    f"""{MANIFESTS} SELECT node_id, unnest(capabilities) AS capability FROM manifests
    WHERE node_id IN (SELECT lpad(l_suppkey::VARCHAR, 6, '0') FROM lineitem GROUP BY 1 HAVING epoch_us(TIMESTAMP '2001-11-01') - epoch_us(max(l_shipdate)) < 20 * 86400000000)""",
)
def live_candidates_c5(spark, d):
    caps = b.manifests(spark, d).select("node_id", F.explode("capabilities").alias("capability"))
    beats = read_sample(spark, d, "lineitem").select(pad("l_suppkey", 6).alias("node_id"), F.col("l_shipdate").alias("ts"))
    return pl.live_candidates(caps, beats, F.lit("2001-11-01").cast("timestamp"), 20 * 86_400_000)


_OWNED = """t AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, CASE WHEN o_orderstatus = 'O' THEN 'shell.exec' ELSE 'fs.search' END AS capability,
  CASE o_orderpriority WHEN '1-URGENT' THEN '{"path":"x"}' WHEN '2-HIGH' THEN '{"scope":' || o_custkey || '}' ELSE '{"scope":"n' || (o_custkey % 30) || '"}' END AS input FROM orders),
 cand AS (SELECT node_id, unnest(capabilities) AS capability, s_acctbal > 8000 AS paused FROM manifests),
 sc AS (SELECT node_id, unnest(scopes) AS scope_id FROM manifests),
 own AS (SELECT scope_id, capability, min(node_id) FILTER (NOT paused) AS owner FROM sc JOIN cand USING (node_id) GROUP BY ALL)"""


def _candidates(m):
    return m.select("node_id", F.explode("capabilities").alias("capability"), (F.col("s_acctbal") > 8000).alias("paused"))


@query(
    "scope_owners_c6",
    f"""{MANIFESTS}, {_OWNED}, k AS (SELECT *, CASE WHEN json_type(input, '$.scope') = 'VARCHAR' THEN input->>'$.scope' END AS scope_id,
      CASE WHEN json_type(input, '$.scope') IS NULL THEN 'missing_scope_field' WHEN json_type(input, '$.scope') <> 'VARCHAR' THEN 'scope_field_not_string' END AS bad FROM t)
    SELECT id, k.scope_id, owner AS node_id, coalesce(bad, CASE WHEN own.scope_id IS NULL THEN 'no_live_owner' WHEN owner IS NULL THEN 'resource_gated' END) AS reason
    FROM k LEFT JOIN own ON own.scope_id = k.scope_id AND own.capability = k.capability""",
)
def scope_owners_c6(spark, d):
    o = read_sample(spark, d, "orders")
    cust = F.col("o_custkey")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", '{"path":"x"}')
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit('{"scope":'), cust.cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"scope":"n'), (cust % 30).cast("string"), F.lit('"}')))
    )
    tasks = o.select(
        pad("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "shell.exec").otherwise("fs.search").alias("capability"),
        F.lit("scope").alias("scope_field"),
        text.alias("input"),
    )
    m = b.manifests(spark, d)
    return pl.scope_owners(tasks, m.select("node_id", F.explode("scopes").alias("scope_id")), _candidates(m))


_PINNED = """t AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, CASE WHEN o_orderstatus = 'F' THEN lpad((o_custkey % 40)::VARCHAR, 6, '0') END AS pin_node,
   CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'n' || (o_custkey % 30) END AS pin_scope FROM orders),
 live AS (SELECT node_id FROM manifests WHERE s_acctbal > 2000),
 cand AS (SELECT DISTINCT lpad(l_orderkey::VARCHAR, 12, '0') AS task_id, lpad(l_suppkey::VARCHAR, 6, '0') AS node_id FROM lineitem),
 sc AS (SELECT DISTINCT node_id, unnest(scopes) AS scope_id FROM manifests WHERE node_id IN (FROM live)),
 j AS (SELECT id, pin_node, pin_scope, CASE WHEN pin_node IS NOT NULL AND pin_node NOT IN (FROM live) THEN 'pinned_node_not_live'
   WHEN pin_scope IS NOT NULL AND pin_scope NOT IN (SELECT scope_id FROM sc) THEN 'pinned_scope_unowned' END AS reason FROM t),
 kept AS (SELECT task_id, node_id FROM cand JOIN j ON j.id = task_id WHERE reason IS NULL AND (pin_node IS NULL OR pin_node = node_id)
   AND (pin_scope IS NULL OR EXISTS (SELECT 1 FROM sc WHERE sc.node_id = cand.node_id AND sc.scope_id = pin_scope)))"""


@query(
    "apply_pins_c7",
    f"""{MANIFESTS}, {_PINNED} SELECT task_id, node_id, NULL::VARCHAR AS reason FROM kept UNION ALL SELECT id, NULL, reason FROM j WHERE reason IS NOT NULL
    UNION ALL SELECT id, NULL, 'no_eligible_node' FROM j WHERE reason IS NULL AND id NOT IN (SELECT task_id FROM kept)""",
)
def apply_pins_c7(spark, d):
    o = read_sample(spark, d, "orders")
    tasks = o.select(
        pad("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.lpad((F.col("o_custkey") % 40).cast("string"), 6, "0")).alias("pin_node"),
        F.when(F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW"), F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string"))).alias("pin_scope"),
    )
    m = b.manifests(spark, d)
    li = read_sample(spark, d, "lineitem")
    cand = li.select(pad("l_orderkey").alias("task_id"), pad("l_suppkey", 6).alias("node_id")).distinct()
    scopes = m.select("node_id", F.explode("scopes").alias("scope_id"))
    return pl.apply_pins(cand, tasks, scopes, m.filter(F.col("s_acctbal") > 2000).select("node_id"))


@query(
    "version_lookup_c9",
    """SELECT 'major' AS kind, lpad(p_partkey::VARCHAR, 9, '0') AS node_id, p_size AS version_major FROM part WHERE p_brand = 'Brand#11' AND p_size = 7
    UNION ALL SELECT 'any', lpad(p_partkey::VARCHAR, 9, '0'), p_size FROM part WHERE p_brand = 'Brand#11'""",
)
def version_lookup_c9(spark, d):
    p = read_sample(spark, d, "part")
    caps = p.select(pad("p_partkey", 9).alias("node_id"), F.col("p_brand").alias("capability"), F.col("p_size").alias("version_major"))
    one = pl.version_lookup(caps, "Brand#11", 7).withColumn("version_major", F.lit(7))
    return one.withColumn("kind", F.lit("major")).unionByName(pl.advertisers(caps, "Brand#11").withColumn("kind", F.lit("any")))


_DEMAND = """tasks AS (SELECT o.*, 'n' || c_nationkey AS capability,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'pinned' WHEN '5-LOW' THEN 'light' ELSE 'heavy' END AS cpu_class,
   CASE WHEN o_totalprice > 300000 THEN 8192 WHEN o_totalprice > 100000 THEN 1024 END AS memory_mb, o_orderstatus = 'P' AS gpu_required,
   CASE WHEN o_orderpriority = '2-HIGH' THEN 2048 END AS gpu_memory_mb FROM orders o JOIN customer ON c_custkey = o_custkey),
 nodes AS (SELECT 'n' || s_nationkey AS capability, lpad(s_suppkey::VARCHAR, 6, '0') AS node_id, (s_suppkey % 8)::INT AS cpu_cores, (s_suppkey % 5) * 4096 AS ram_total_mb,
   (s_suppkey % 3) * 2000 AS ram_used_mb, s_suppkey % 2 = 0 AS has_gpu, (s_suppkey % 4) * 1500 AS gpu_total_mb, (s_suppkey % 3) * 500 AS gpu_used_mb,
   (s_suppkey * 13 % 101)::INT AS cpu_busy_pct, (s_suppkey % 6)::INT AS cpu_pinned_count, s_suppkey % 7 AS reported_inflight, s_suppkey % 4 AS assigned_inflight,
   s_acctbal < -500 AS paused, s_suppkey % 9 = 0 AS on_battery, CASE WHEN s_suppkey % 5 > 0 THEN (s_suppkey % 5) / 4.0 END AS success_rate FROM supplier),
 dem AS (SELECT DISTINCT capability, cpu_class, memory_mb, gpu_required, gpu_memory_mb FROM tasks),
 raw AS (SELECT *, greatest(cpu_cores, 1)::DOUBLE AS cores FROM dem JOIN nodes USING (capability)),
 fit AS (SELECT *, CASE WHEN paused OR (gpu_required AND (NOT has_gpu OR (gpu_total_mb > 0 AND coalesce(gpu_memory_mb, 0) > greatest(gpu_total_mb - gpu_used_mb, 0))))
    OR (ram_total_mb > 0 AND coalesce(memory_mb, 0) > greatest(ram_total_mb - ram_used_mb, 0)) OR (cpu_class = 'pinned' AND cpu_cores > 0 AND cpu_pinned_count >= cpu_cores) THEN 0
   ELSE greatest(1 - least(greatest((greatest(cores * cpu_busy_pct / 100.0, greatest(assigned_inflight, reported_inflight) * 0.5) + CASE WHEN cpu_class = 'light' THEN 0.1 ELSE 1 END) / cores, 0), 1), 0.05)
    * greatest(1 - least(CASE WHEN ram_total_mb > 0 THEN (ram_used_mb::DOUBLE + coalesce(memory_mb, 256)) / ram_total_mb ELSE 0 END, 1), 0.05)
    * greatest(1 - least(CASE WHEN gpu_required AND gpu_total_mb > 0 THEN (gpu_used_mb::DOUBLE + coalesce(gpu_memory_mb, 0)) / gpu_total_mb ELSE 0 END, 1), 0.05)
    * least(greatest(coalesce(success_rate, 1), 0.05), 1) / CASE WHEN on_battery THEN 2.0 ELSE 1 END END AS score FROM raw),
 ranked AS (SELECT * FROM fit WHERE score > 0)"""


def _demand_tasks(spark, d):
    o = read_sample(spark, d, "orders")
    c = read_sample(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    p, total = F.col("o_orderpriority"), F.col("o_totalprice")
    return o.join(c, "o_custkey").select(
        pad("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("issued_at"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("capability"),
        F.when(p == "1-URGENT", "pinned").when(p == "5-LOW", "light").otherwise("heavy").alias("cpu_class"),
        F.when(total > 300000, 8192).when(total > 100000, 1024).alias("memory_mb"),
        (F.col("o_orderstatus") == "P").alias("gpu_required"),
        F.when(p == "2-HIGH", 2048).alias("gpu_memory_mb"),
    )


def _demand_nodes(spark, d):
    s = read_sample(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("capability"),
        pad("s_suppkey", 6).alias("node_id"),
        (k % 8).cast("int").alias("cpu_cores"),
        (k % 5 * 4096).alias("ram_total_mb"),
        (k % 3 * 2000).alias("ram_used_mb"),
        (k % 2 == 0).alias("has_gpu"),
        (k % 4 * 1500).alias("gpu_total_mb"),
        (k % 3 * 500).alias("gpu_used_mb"),
        (k * 13 % 101).cast("int").alias("cpu_busy_pct"),
        (k % 6).cast("int").alias("cpu_pinned_count"),
        (k % 7).alias("reported_inflight"),
        (k % 4).alias("assigned_inflight"),
        (F.col("s_acctbal") < -500).alias("paused"),
        (k % 9 == 0).alias("on_battery"),
        F.when(k % 5 > 0, k % 5 / 4.0).alias("success_rate"),
    )


@query(
    "rank_candidates_c10",
    f"WITH {_DEMAND} SELECT capability, cpu_class, memory_mb, gpu_required, gpu_memory_mb, node_id, round(score, 9) AS score FROM ranked",
)
def rank_candidates_c10(spark, d):
    out = pl.rank_candidates(_demand_tasks(spark, d), _demand_nodes(spark, d))
    return out.drop("demand_id").withColumn("score", F.round("score", 9))


_KEY = "capability, cpu_class, memory_mb, gpu_required, gpu_memory_mb"


@query(
    "pick_candidate_c11",
    f"""WITH {_DEMAND}, band AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY node_id) AS seat, count(*) OVER (PARTITION BY {_KEY}) AS n FROM (
      SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY {_KEY}) AS best FROM ranked) WHERE score >= best * 0.99)),
    turns AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY o_orderdate, o_orderkey) AS turn FROM tasks)
    SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, node_id, round(score, 9) AS score FROM turns t JOIN band b ON t.capability = b.capability AND t.cpu_class = b.cpu_class
      AND t.memory_mb IS NOT DISTINCT FROM b.memory_mb AND t.gpu_required = b.gpu_required AND t.gpu_memory_mb IS NOT DISTINCT FROM b.gpu_memory_mb AND b.seat = (turn - 1) % n + 1""",
)
def pick_candidate_c11(spark, d):
    tasks = _demand_tasks(spark, d)
    out = pl.pick_candidate(tasks, pl.candidate_bands(tasks, _demand_nodes(spark, d)))
    return out.withColumn("score", F.round("score", 9))


@query(
    "candidate_bands_c10",
    f"""WITH {_DEMAND} SELECT {_KEY}, node_id, round(score, 9) AS score FROM (SELECT *, max(score) OVER (PARTITION BY {_KEY}) AS best FROM ranked) WHERE score >= best * 0.99""",
)
def candidate_bands_c10(spark, d):
    """Only the nodes that a demand may get: what is dominated is never joined with it."""
    out = pl.candidate_bands(_demand_tasks(spark, d), _demand_nodes(spark, d))
    return out.drop("demand_id").withColumn("score", F.round("score", 9))


@query(
    "effective_hints_c10",
    f"""WITH {_DEMAND} SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, CASE WHEN cpu_class = 'light' AND capability IN ('n1', 'n2') THEN 'heavy' ELSE cpu_class END AS cpu_class,
    CASE WHEN capability IN ('n1', 'n2') THEN greatest(coalesce(memory_mb, 0), 2048) ELSE memory_mb END AS memory_mb, gpu_required OR capability = 'n2' AS gpu_required, gpu_memory_mb FROM tasks""",
)
def effective_hints_c10(spark, d):
    n = read_sample(spark, d, "nation").filter(F.col("n_nationkey").isin(1, 2))
    hints = n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("capability"),
        F.lit("heavy").alias("cpu_class"),
        F.lit(2048).alias("memory_mb"),
        (F.col("n_nationkey") == 2).alias("gpu_required"),
        F.lit(None).cast("int").alias("gpu_memory_mb"),
    )
    return pl.effective_hints(_demand_tasks(spark, d), hints).select("id", "cpu_class", "memory_mb", "gpu_required", "gpu_memory_mb")


@query(
    "node_score_e27",
    """WITH i AS (SELECT sha256(s_name) AS node_id, s_suppkey AS k FROM supplier)
    SELECT node_id, (('0x' || node_id[1:2])::INT + ('0x' || node_id[3:4])::INT + ('0x' || node_id[5:6])::INT + ('0x' || node_id[7:8])::INT
      + CASE WHEN k % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 200 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 50 ELSE 0 END + 30 * (k % 8) + 50 * ((k % 100) // 16)
      - CASE WHEN k % 7 = 0 THEN 100 ELSE 0 END - 200 * least(k % 4, 1) - 10 * (k % 6))::BIGINT AS score FROM i""",
)
def node_score_e27(spark, d):
    s = read_sample(spark, d, "supplier")
    k = F.col("s_suppkey")
    return pl.node_score(
        s.select(
            F.sha2("s_name", 256).alias("node_id"),
            (k % 2 == 0).alias("has_local_fast_planner"),
            (k % 3 == 0).alias("has_local_strong_planner"),
            (k % 5 == 0).alias("has_cloud_planner_keys"),
            (k % 8).alias("cpu_cores"),
            (k % 100).alias("ram_gb"),
            (k % 7 == 0).alias("on_battery_unplugged"),
            (k % 4).alias("recently_demoted"),
            (k % 6).alias("planner_error_rate_pct"),
        )
    )


@query(
    "intersect_owners_i3",
    "SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS node_id FROM supplier WHERE s_acctbal > 1000 INTERSECT SELECT lpad(l_suppkey::VARCHAR, 6, '0') FROM lineitem WHERE l_quantity > 49",
)
def intersect_owners_i3(spark, d):
    s = read_sample(spark, d, "supplier").filter(F.col("s_acctbal") > 1000).select(pad("s_suppkey", 6).alias("node_id"))
    li = read_sample(spark, d, "lineitem").filter(F.col("l_quantity") > 49).select(pad("l_suppkey", 6).alias("node_id"))
    return pl.intersect_owners(s, li)


# --- rules ---------------------------------------------------------------------------------------------------

RULES = [
    ("shell", "deny", 1, "rm", True, None, None, None, None, None, None),
    ("shell", "deny", 2, None, None, None, "a 7", None, None, None, None),
    ("shell", "deny", 3, "ls", False, None, None, None, None, None, None),
    ("shell", "allow", 4, "ls", True, None, None, None, None, None, None),
    ("shell", "allow", 5, "git", False, ["a", "b"], None, None, None, None, None),
    ("shell", "allow", 6, "cat", False, None, None, None, None, None, None),
    ("llm", "deny", 1, None, None, None, None, "m1", None, None, None),
    ("llm", "allow", 2, None, None, None, None, None, "m1", None, None),
    ("mcp", "deny", 1, None, None, None, None, None, None, "s1", "t3"),
    ("mcp", "allow", 2, None, None, None, None, None, None, "s1", None),
    ("mcp", "allow", 3, None, None, None, None, None, None, "s2", "t2"),
]
RULE_SCHEMA = "kind string, effect string, rule_no int, cmd string, any_args boolean, subcmds array<string>, pattern string, model string, model_prefix string, server string, tool string"
TRUST = [("shell", "u3", "untrusted"), ("shell", "u4", "trusted"), ("llm", "*", "untrusted"), ("llm", "u5", "default"), ("llm", "u6", "trusted"), ("llm", "u7", "trusted"), ("mcp", "u8", "untrusted")]

_REQUESTS = """req AS (SELECT event_id AS request_id, CASE event_type WHEN 'click' THEN 'llm' WHEN 'view' THEN 'mcp' WHEN 'signup' THEN 'secret' ELSE 'shell' END AS kind,
  'u' || (user_id % 10) AS from_node, ['ls', 'git', 'rm', 'cat'][(k % 4 + 1)::INT] AS cmd,
  CASE WHEN k % 3 = 0 THEN [] WHEN k % 3 = 1 THEN ['a', k::VARCHAR] ELSE ['c'] END AS args, 'm' || (k % 30) AS model, 's' || (k % 3) AS server, 't' || (k % 4) AS tool
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
 tr AS (SELECT *, coalesce(CASE WHEN kind = 'shell' THEN CASE from_node WHEN 'u3' THEN 'untrusted' WHEN 'u4' THEN 'trusted' END
   WHEN kind = 'llm' THEN CASE from_node WHEN 'u5' THEN 'default' WHEN 'u6' THEN 'trusted' WHEN 'u7' THEN 'trusted' ELSE 'untrusted' END
   WHEN kind = 'mcp' THEN CASE from_node WHEN 'u8' THEN 'untrusted' END END, 'default') AS trust FROM req)"""


def _requests(spark, d):
    e = read_sample(spark, d, "events").withColumn("k", b.k_of())
    k = F.col("k")
    t = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    kind = b.choose("event_type", {"click": "llm", "view": "mcp", "signup": "secret"})
    args = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("a"), k.cast("string"))).otherwise(F.array(F.lit("c")))
    return e.select(
        F.col("event_id").alias("request_id"),
        F.coalesce(kind, F.lit("shell")).alias("kind"),
        t("u", F.col("user_id") % 10).alias("from_node"),
        F.element_at(F.array(F.lit("ls"), F.lit("git"), F.lit("rm"), F.lit("cat")), (k % 4 + 1).cast("int")).alias("cmd"),
        args.alias("args"),
        t("m", k % 30).alias("model"),
        t("s", k % 3).alias("server"),
        t("t", k % 4).alias("tool"),
    )


def _trust(spark):
    return spark.createDataFrame(TRUST, "kind string, node string, level string")


@query("resolve_trust_c18", f"WITH {_REQUESTS} SELECT request_id, kind, from_node, trust FROM tr")
def resolve_trust_c18(spark, d):
    return ru.resolve_trust(_requests(spark, d), _trust(spark)).select("request_id", "kind", "from_node", "trust")


@query(
    "evaluate_rules_c17",
    f"""WITH {_REQUESTS}, w AS (SELECT *, array_to_string(list_concat([cmd], args), ' ') AS whole FROM tr),
    m AS (SELECT *, CASE kind WHEN 'shell' THEN CASE WHEN cmd = 'rm' THEN 1 WHEN contains(whole, 'a 7') THEN 2 WHEN cmd = 'ls' AND len(args) = 0 THEN 3 END
        WHEN 'llm' THEN CASE WHEN model = 'm1' THEN 1 END WHEN 'mcp' THEN CASE WHEN server = 's1' AND tool = 't3' THEN 1 END END AS deny_no,
      CASE kind WHEN 'shell' THEN CASE WHEN cmd = 'ls' THEN 4 WHEN cmd = 'git' AND len(args) > 0 AND args[1] IN ('a', 'b') THEN 5 WHEN cmd = 'cat' AND len(args) = 0 THEN 6 END
        WHEN 'llm' THEN CASE WHEN starts_with(model, 'm1') THEN 2 END WHEN 'mcp' THEN CASE WHEN server = 's1' THEN 2 WHEN server = 's2' AND tool = 't2' THEN 3 END END AS allow_no FROM w),
    r AS (SELECT *, CASE WHEN kind = 'secret' THEN 'always_allowed' WHEN trust = 'untrusted' THEN 'untrusted_source' WHEN deny_no IS NOT NULL THEN 'deny_rule'
      WHEN allow_no IS NOT NULL THEN 'allow_rule' ELSE 'no_rule_matched' END AS reason FROM m)
    SELECT request_id, kind, CASE WHEN reason IN ('always_allowed', 'allow_rule') THEN 'allow' ELSE 'deny' END AS decision, reason,
    CASE reason WHEN 'deny_rule' THEN deny_no WHEN 'allow_rule' THEN allow_no END AS rule_no FROM r""",
)
def evaluate_rules_c17(spark, d):
    return ru.evaluate_rules(_requests(spark, d), spark.createDataFrame(RULES, RULE_SCHEMA), _trust(spark))


_GOALS = """g AS (SELECT conv_id || '-' || turn AS id, CASE turn % 8 WHEN 0 THEN '  run: ' WHEN 1 THEN 'shell:' WHEN 2 THEN 'search: ' WHEN 3 THEN 'fetch:' WHEN 4 THEN 'Run:' WHEN 5 THEN 'summarize:' ELSE '' END || text || ' ' AS text FROM conversations)"""


@query(
    "route_by_prefix_c19",
    rf"""WITH {_GOALS}, t AS (SELECT id, regexp_replace(text, '^\s+', '') AS goal FROM g),
    p AS (SELECT *, CASE WHEN starts_with(goal, 'run:') THEN 'run:' WHEN starts_with(goal, 'shell:') THEN 'shell:' WHEN starts_with(goal, 'search:') THEN 'search:' WHEN starts_with(goal, 'fetch:') THEN 'fetch:' WHEN starts_with(goal, 'summarize:') THEN 'summarize:' END AS prefix FROM t),
    o AS (SELECT *, CASE WHEN prefix IN ('run:', 'shell:') THEN 'matched' WHEN prefix IN ('fetch:', 'summarize:') THEN 'matched_but_unsupported' ELSE 'no_match' END AS outcome FROM p)
    SELECT id, outcome, CASE WHEN outcome <> 'no_match' THEN prefix END AS prefix, CASE WHEN outcome = 'no_match' THEN NULL WHEN prefix IN ('run:', 'shell:') THEN 'shell.exec' WHEN prefix = 'fetch:' THEN 'http.fetch' ELSE 'doc.summarize' END AS capability,
    CASE WHEN outcome = 'matched' THEN regexp_replace(goal[length(prefix) + 1:], '^\s+|\s+$', '', 'g') END AS body FROM o""",
)
def route_by_prefix_c19(spark, d):
    c = read_sample(spark, d, "conversations")
    lead = {0: "  run: ", 1: "shell:", 2: "search: ", 3: "fetch:", 4: "Run:", 5: "summarize:"}
    prefix = F.lit("")
    for n, text in lead.items():
        prefix = F.when(F.col("turn") % 8 == n, text).otherwise(prefix)
    texts = c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(prefix, F.col("text"), F.lit(" ")).alias("text"),
    )
    offered = b.manifests(spark, d).select(F.explode("capabilities").alias("capability")).distinct()
    offered = offered.unionByName(offered.select(F.lit("mesh.search").alias("capability")).distinct())
    return ru.route_by_prefix(texts, offered)


@query(
    "intake_filter_b12",
    f"""{ctes("messages", "allowlist")} SELECT message_id, channel, sender FROM messages WHERE sender IN (FROM allowlist) AND opt_out_type IS NULL AND trim(coalesce(body, '')) <> ''""",
)
def intake_filter_b12(spark, d):
    return ru.intake_filter(b.messages(spark, d), b.allowlist(spark, d)).select("message_id", "channel", "sender")


@query(
    "intake_near_misses_b12",
    f"""{ctes("messages", "allowlist")}, s AS (SELECT sender, count(*) AS messages, CASE WHEN starts_with(sender, 'whatsapp:') THEN sender[10:] ELSE 'whatsapp:' || sender END AS other_form
      FROM messages WHERE sender NOT IN (FROM allowlist) GROUP BY sender) SELECT sender, messages, other_form FROM s WHERE other_form IN (FROM allowlist)""",
)
def intake_near_misses_b12(spark, d):
    return ru.intake_near_misses(b.messages(spark, d), b.allowlist(spark, d))


@query(
    "check_records_b14",
    """SELECT event_id, list_filter([CASE WHEN value < 1 THEN 'value:min' END, CASE WHEN value > 200 THEN 'value:max' END, CASE WHEN event_type NOT IN ('click', 'view', 'signup') THEN 'event_type:enum' END,
      CASE WHEN length(props) < 9 THEN 'props:min_length' END, CASE WHEN note IS NULL THEN 'note:required' END, CASE WHEN event_type = 'error' THEN 'payload:no_extra_keys' END], lambda x: x IS NOT NULL) AS violations
    FROM (SELECT *, CASE WHEN event_type <> 'view' THEN 'x' END AS note FROM events)""",
)
def check_records_b14(spark, d):
    e = read_sample(spark, d, "events").withColumns(
        {
            "note": F.when(F.col("event_type") != "view", "x"),
            "payload": F.when(F.col("event_type") == "error", F.lit('{"k":1,"z":2}')).otherwise(F.col("props")),
        }
    )
    rules = [
        {"rule": "min", "field": "value", "bound": 1},
        {"rule": "max", "field": "value", "bound": 200},
        {"rule": "enum", "field": "event_type", "values": ["click", "view", "signup"]},
        {"rule": "min_length", "field": "props", "length": 9},
        {"rule": "required", "field": "note"},
        {"rule": "no_extra_keys", "field": "payload", "values": ["k"]},
    ]
    return ru.check_records(e, rules).select("event_id", "violations")
