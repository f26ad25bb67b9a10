"""Queries: task and lease histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes, pad
from fleetlens.catalog.registry import query
from fleetlens.operators import lifecycle as lc
from fleetlens.sources.tables import read_sample
from fleetlens.vocab import LEGAL_TRANSITIONS, STATES

TASKS = ctes("tasks")
EVENTS = ctes("task_events")
_RANK = "list_position([" + ", ".join(f"'{s}'" for s in STATES) + "], {c}) - 1"
RANK = _RANK.format(c="state")


def us(column: str):
    return F.unix_micros(column)


@query(
    "list_tasks_b6",
    f"{TASKS} SELECT id, capability, state, epoch_us(issued_at) AS issued_us FROM tasks WHERE capability = 'plan.execute' AND state = 'running' ORDER BY issued_at DESC, id DESC LIMIT 500",
)
def list_tasks_b6(spark, d):
    out = lc.list_tasks(b.tasks(spark, d), "plan.execute", "running", 500)
    return out.select("id", "capability", "state", us("issued_at").alias("issued_us"))


@query(
    "list_by_state_assigned_b7",
    f"{TASKS} SELECT id, state, assigned_node FROM tasks WHERE state = 'submitted' AND assigned_node IS NULL UNION ALL SELECT id, state, assigned_node FROM tasks WHERE state = 'running' AND assigned_node = 'n3'",
)
def list_by_state_assigned_b7(spark, d):
    t = b.tasks(spark, d)
    both = lc.list_by_state_assigned(t, "submitted", None).unionByName(lc.list_by_state_assigned(t, "running", "n3"))
    return both.select("id", "state", "assigned_node")


@query("count_by_state_d11", f"{TASKS} SELECT state, count(*) AS tasks FROM tasks GROUP BY state")
def count_by_state_d11(spark, d):
    return lc.count_by_state(b.tasks(spark, d))


@query(
    "inflight_by_node_d11",
    f"{TASKS} SELECT assigned_node, count(*) AS inflight FROM tasks WHERE state IN ('dispatched', 'claimed', 'running') AND assigned_node IS NOT NULL GROUP BY assigned_node",
)
def inflight_by_node_d11(spark, d):
    return lc.inflight_by_node(b.tasks(spark, d))


_LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {RANK} DESC, at_ts DESC, source DESC) AS r FROM task_events) WHERE r = 1)"""


@query("lww_latest_d14", f"{EVENTS}, {_LATEST} SELECT task_id, state, epoch_us(at_ts) AS at_us, source, event_id FROM latest")
def lww_latest_d14(spark, d):
    return lc.lww_latest(b.task_events(spark, d)).select("task_id", "state", us("at").alias("at_us"), "source", "event_id")


@query(
    "state_fingerprint_d15",
    f"""{EVENTS} SELECT capability AS node_id, sum(('0x' || substr(sha256(concat_ws('|', task_id, state, epoch_us(at_ts)::VARCHAR, source)), 1, 15))::HUGEINT)::VARCHAR AS digest,
    count(*) AS entries, epoch_us(max(at_ts)) AS newest_us FROM task_events GROUP BY capability""",
)
def state_fingerprint_d15(spark, d):
    replica = b.task_events(spark, d).withColumn("node_id", F.col("capability"))
    return lc.state_fingerprint(replica).select("node_id", "digest", "entries", us("newest").alias("newest_us"))


@query(
    "state_counts_d15",
    f"{EVENTS} SELECT capability AS node_id, count(*) AS entries, epoch_us(max(at_ts)) AS newest_us FROM task_events GROUP BY capability",
)
def state_counts_d15(spark, d):
    replica = b.task_events(spark, d).withColumn("node_id", F.col("capability"))
    return lc.state_fingerprint(replica).select("node_id", "entries", us("newest").alias("newest_us"))


@query(
    "apply_lww_g4",
    f"""{EVENTS}, half AS (SELECT *, at_ts < TIMESTAMP '2024-01-16' AS early FROM task_events),
    o AS (SELECT * FROM (SELECT *, {RANK} AS k, row_number() OVER (PARTITION BY task_id ORDER BY {RANK} DESC, at_ts DESC, source DESC) AS r FROM half WHERE early) WHERE r = 1),
    n AS (SELECT * FROM (SELECT *, {RANK} AS k, row_number() OVER (PARTITION BY task_id ORDER BY {RANK} DESC, at_ts DESC, source DESC) AS r FROM half WHERE NOT early) WHERE r = 1)
    SELECT n.task_id, o.state AS old_state, n.state, epoch_us(n.at_ts) AS at_us, n.source FROM n LEFT JOIN o USING (task_id)
    WHERE o.task_id IS NULL OR (n.k, n.at_ts, n.source) > (o.k, o.at_ts, o.source)""",
)
def apply_lww_g4(spark, d):
    e = b.task_events(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    changed = lc.lww_changes(e.filter(F.col("at") >= cut), lc.lww_latest(e.filter(F.col("at") < cut)))
    return changed.select("task_id", "old_state", "state", us("at").alias("at_us"), "source")


_WATERMARKS = """w AS (SELECT capability AS node_id, 'a' AS peer, TIMESTAMP '2024-01-10' AS watermark FROM task_events GROUP BY 1
 UNION ALL SELECT capability, 'b', min(at_ts) + INTERVAL 20 DAY FROM task_events GROUP BY 1)"""


def _watermarks(e):
    nodes = e.groupBy(F.col("capability").alias("node_id")).agg(F.min("at").alias("first"))
    a = nodes.select("node_id", F.lit("a").alias("peer"), F.lit("2024-01-10").cast("timestamp").alias("watermark"))
    return a.unionByName(nodes.select("node_id", F.lit("b").alias("peer"), (F.col("first") + F.expr("INTERVAL 20 DAYS")).alias("watermark")))


@query(
    "delta_since_g5",
    f"""{EVENTS}, {_WATERMARKS} SELECT w.node_id, peer, task_id, state, epoch_us(at_ts) AS at_us, source,
    (row_number() OVER (PARTITION BY w.node_id, peer ORDER BY at_ts, task_id, source) - 1) // 350 AS chunk
    FROM task_events e JOIN w ON w.node_id = e.capability WHERE at_ts > watermark""",
)
def delta_since_g5(spark, d):
    e = b.task_events(spark, d)
    replica = e.select(F.col("capability").alias("node_id"), "task_id", "state", "at", "source")
    out = lc.delta_since(replica, _watermarks(e))
    return out.select("node_id", "peer", "task_id", "state", us("at").alias("at_us"), "source", "chunk")


@query(
    "next_watermarks_g5",
    f"{EVENTS}, {_WATERMARKS} SELECT w.node_id, peer, epoch_us(greatest(watermark, m)) AS watermark_us FROM w JOIN (SELECT capability AS node_id, max(at_ts) AS m FROM task_events GROUP BY 1) USING (node_id)",
)
def next_watermarks_g5(spark, d):
    e = b.task_events(spark, d)
    out = lc.next_watermarks(e.withColumn("node_id", F.col("capability")), _watermarks(e))
    return out.select("node_id", "peer", us("watermark").alias("watermark_us"))


_LEASES = """leases AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS task_id, a AS attempt, lpad(o_orderkey::VARCHAR, 12, '0') || '/' || a AS lease_id,
   's' || (o_custkey % 9) AS worker_id, o_orderdate + to_days((30 * (a - 1))::INT) AS issued_at, o_orderdate + to_days((30 * (a - 1) + 45)::INT) AS expires_at,
   CASE WHEN o_orderstatus = 'O' THEN 'claimed' WHEN a = 1 THEN 'expired' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'completed' END AS state,
   (o_custkey % 3 + 1)::INT AS max_attempts
 FROM orders, (SELECT unnest([1, 2, 3]) AS a))"""


def _leases(spark, d):
    o = read_sample(spark, d, "orders")
    l = o.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    start = (F.col("attempt") - 1) * 30
    day = lambda n: F.col("o_orderdate") + F.make_dt_interval(n)
    state = (
        F.when(F.col("o_orderstatus") == "O", "claimed").when(F.col("attempt") == 1, "expired").when(F.col("o_orderstatus") == "P", "pending").otherwise("completed")
    )
    return l.select(
        pad("o_orderkey").alias("task_id"),
        "attempt",
        F.concat_ws("/", pad("o_orderkey"), F.col("attempt").cast("string")).alias("lease_id"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string")).alias("worker_id"),
        day(start).alias("issued_at"),
        day(start + 45).alias("expires_at"),
        state.alias("state"),
        (F.col("o_custkey") % 3 + 1).cast("int").alias("max_attempts"),
    )


@query(
    "lease_at_c15",
    f"""WITH {_LEASES}, ev AS (SELECT DISTINCT lpad(l_orderkey::VARCHAR, 12, '0') AS task_id, l_shipdate AS at_ts FROM lineitem)
    SELECT event_id, task_id, lease_id, worker_id, attempt FROM (
      SELECT ev.task_id || '@' || strftime(at_ts, '%Y%m%d') AS event_id, ev.task_id, lease_id, worker_id, attempt,
        row_number() OVER (PARTITION BY ev.task_id, at_ts ORDER BY attempt DESC, lease_id DESC) AS r
      FROM ev JOIN leases l ON l.task_id = ev.task_id AND at_ts BETWEEN issued_at AND expires_at) WHERE r = 1""",
)
def lease_at_c15(spark, d):
    li = read_sample(spark, d, "lineitem").select(pad("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("at")).distinct()
    ev = li.withColumn("event_id", F.concat_ws("@", "task_id", F.date_format("at", "yyyyMMdd")))
    return lc.lease_at(_leases(spark, d).select("task_id", "lease_id", "worker_id", "attempt", "issued_at", "expires_at"), ev).select(
        "event_id", "task_id", "lease_id", "worker_id", "attempt"
    )


@query(
    "backlog_admission_d19",
    """WITH t AS (SELECT 'q' || (o_custkey % 4) AS queue, o_orderdate AS a, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_days((o_orderkey % 40)::INT) END AS z FROM orders),
    m AS (SELECT queue, a AS at_ts, 1 AS delta FROM t UNION ALL SELECT queue, z, -1 FROM t WHERE z IS NOT NULL),
    p AS (SELECT queue, date_trunc('day', at_ts) AS bucket, sum(delta) AS change FROM m GROUP BY ALL)
    SELECT queue, strftime(bucket, '%Y-%m-%d') AS day, change::BIGINT AS change, (sum(change) OVER w)::BIGINT AS backlog, sum(change) OVER w >= 100 AS refused
    FROM p WINDOW w AS (PARTITION BY queue ORDER BY bucket ROWS UNBOUNDED PRECEDING)""",
)
def backlog_admission_d19(spark, d):
    o = read_sample(spark, d, "orders")
    left = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 40).cast("int")))
    t = o.select(
        F.concat(F.lit("q"), (F.col("o_custkey") % 4).cast("string")).alias("queue"), F.col("o_orderdate").alias("submitted_at"), left.alias("left_at")
    )
    out = lc.backlog_admission(t, 100, "1 day")
    return out.select("queue", F.date_format("bucket", "yyyy-MM-dd").alias("day"), "change", "backlog", "refused")


_PAIRS = ", ".join(f"'{a}>{z}'" for a, zs in LEGAL_TRANSITIONS.items() for z in zs)


@query(
    "illegal_transitions_e16",
    f"""{EVENTS} SELECT task_id, event_id, previous, state FROM (SELECT *, lag(state) OVER (PARTITION BY task_id ORDER BY at_ts, event_id) AS previous FROM task_events)
    WHERE previous IS NOT NULL AND previous <> state AND previous || '>' || state NOT IN ({_PAIRS})""",
)
def illegal_transitions_e16(spark, d):
    return lc.illegal_transitions(b.task_events(spark, d))


_STAGES = """st AS (SELECT task_id, capability, min(ms) FILTER (state = 'submitted') AS a, min(ms) FILTER (state = 'claimed') AS c,
  min(ms) FILTER (state = 'running') AS r, max(ms) FILTER (state IN ('done', 'failed')) AS z
  FROM (SELECT *, epoch_us(at_ts) // 1000 AS ms FROM task_events) GROUP BY task_id, capability)"""


@query(
    "stage_durations_e17",
    f"{EVENTS}, {_STAGES} SELECT task_id, capability, c - a AS queued_ms, r - c AS starting_ms, z - r AS running_ms FROM st",
)
def stage_durations_e17(spark, d):
    return lc.stage_durations(b.task_events(spark, d))


@query(
    "stage_percentiles_e17",
    f"""{EVENTS}, {_STAGES}, du AS (SELECT capability, c - a AS queued_ms, r - c AS starting_ms, z - r AS running_ms FROM st)
    SELECT capability, count(*) AS tasks, {', '.join(f"quantile_disc({s}, {q}) AS p{round(q * 100)}_{s}" for s in ('queued_ms', 'starting_ms', 'running_ms') for q in (0.5, 0.95))} FROM du GROUP BY capability""",
)
def stage_percentiles_e17(spark, d):
    return lc.stage_percentiles(lc.stage_durations(b.task_events(spark, d)))


@query(
    "expired_leases_e18",
    f"WITH {_LEASES} SELECT lease_id, task_id, state FROM leases WHERE state IN ('pending', 'claimed') AND expires_at < TIMESTAMP '1998-06-01'",
)
def expired_leases_e18(spark, d):
    return lc.expired_leases(_leases(spark, d), F.lit("1998-06-01").cast("timestamp")).select("lease_id", "task_id", "state")


@query(
    "expiry_outcome_e18",
    f"""WITH {_LEASES} SELECT lease_id, task_id, attempt, CASE WHEN attempt >= max_attempts THEN 'expired' ELSE 'reset' END AS outcome,
    CASE WHEN attempt < max_attempts THEN least(30000, 250 * 2 ** (attempt - 1))::BIGINT END AS backoff_ms
    FROM leases WHERE state IN ('pending', 'claimed') AND expires_at < TIMESTAMP '1998-06-01'""",
)
def expiry_outcome_e18(spark, d):
    leases = _leases(spark, d)
    tasks = leases.filter(F.col("attempt") == 1).select(F.col("task_id").alias("id"), "max_attempts")
    return lc.expiry_outcome(leases.drop("max_attempts"), tasks, F.lit("1998-06-01").cast("timestamp"))


@query(
    "retry_schedule_e19",
    """SELECT task_id, a::INT AS attempt, least(30000, 250 * 2.0 ** (a - 1))::BIGINT AS backoff_ms FROM (
    SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS task_id, unnest(range(1, o_custkey % 12 + 2)) AS a FROM orders)""",
)
def retry_schedule_e19(spark, d):
    o = read_sample(spark, d, "orders")
    return lc.retry_schedule(o.select(pad("o_orderkey").alias("id"), (F.col("o_custkey") % 12 + 1).alias("max_attempts")))


@query(
    "orphans_e20",
    f"""{TASKS} SELECT id AS task_id, assigned_node, issued_by, CASE WHEN issued_by = assigned_node THEN 'fail' ELSE 'rerun' END AS action FROM tasks
    WHERE state IN ('claimed', 'running') AND assigned_node IS NOT NULL AND assigned_node NOT IN (SELECT DISTINCT 'n' || (s_suppkey % 4) FROM supplier WHERE s_acctbal > 0)""",
)
def orphans_e20(spark, d):
    s = read_sample(spark, d, "supplier").filter(F.col("s_acctbal") > 0)
    alive = s.select(F.concat(F.lit("n"), (F.col("s_suppkey") % 4).cast("string")).alias("node_id")).distinct()
    return lc.orphans(b.tasks(spark, d), alive)


_TREE = """t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 END AS parent_id, o_orderdate AS issued_at FROM orders)"""


@query(
    "run_tree_e29",
    f"""WITH {_TREE}, listed AS (SELECT * FROM t ORDER BY issued_at DESC, id DESC LIMIT 500)
    SELECT c.id, CASE WHEN p.id IS NOT NULL THEN c.parent_id ELSE c.id END AS root_id, epoch_us(coalesce(p.issued_at, c.issued_at)) AS root_us,
    p.id IS NOT NULL AS is_child FROM listed c LEFT JOIN listed p ON p.id = c.parent_id
    UNION ALL SELECT c.id, CASE WHEN p.id IS NOT NULL THEN c.parent_id ELSE c.id END, epoch_us(coalesce(p.issued_at, c.issued_at)), p.id IS NOT NULL FROM t c LEFT JOIN t p ON p.id = c.parent_id""",
)
def run_tree_e29(spark, d):
    o = read_sample(spark, d, "orders")
    k = F.col("o_orderkey")
    t = o.select(k.alias("id"), F.when(k % 4 != 0, k - k % 4).alias("parent_id"), F.col("o_orderdate").alias("issued_at"))
    both = lc.run_tree(t, 500).unionByName(lc.run_tree(t))
    return both.select("id", "root_id", us("root_issued_at").alias("root_us"), "is_child")


@query(
    "exit_summary_d16",
    """WITH r AS (SELECT l_orderkey AS run_id, CASE l_linestatus WHEN 'O' THEN 'running' ELSE 'done' END AS state, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS exit_code,
      l_tax = 0.08 AS timed_out FROM lineitem)
    SELECT run_id, count(*) AS nodes, count(*) FILTER (exit_code = 0 AND NOT timed_out) AS exit_zero, count(*) FILTER (timed_out) AS timed_out,
    count(*) FILTER (NOT timed_out AND exit_code <> 0 AND state <> 'done') AS not_done, count(*) FILTER (NOT timed_out AND exit_code <> 0 AND state = 'done') AS exit_nonzero
    FROM r GROUP BY run_id""",
)
def exit_summary_d16(spark, d):
    li = read_sample(spark, d, "lineitem")
    return lc.exit_summary(
        li.select(
            F.col("l_orderkey").alias("run_id"),
            F.when(F.col("l_linestatus") == "O", "running").otherwise("done").alias("state"),
            F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("exit_code"),
            (F.col("l_tax") == 0.08).alias("timed_out"),
        )
    )


@query(
    "state_changes_g15",
    f"""{EVENTS} SELECT task_id, event_id, previous, state FROM (SELECT *, lag(state) OVER w AS previous,
      count(*) FILTER (state IN ('done', 'failed')) OVER (PARTITION BY task_id ORDER BY at_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
      FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY at_ts, event_id)) WHERE previous IS DISTINCT FROM state AND ended = 0""",
)
def state_changes_g15(spark, d):
    return lc.state_changes(b.task_events(spark, d)).select("task_id", "event_id", "previous", "state")
