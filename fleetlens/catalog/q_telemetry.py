"""Queries: heartbeats, progress, and the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes
from fleetlens.catalog.registry import query
from fleetlens.operators import first_record as fr
from fleetlens.operators import telemetry as te
from fleetlens.sources.tables import read_sample

BEATS = ctes("heartbeats")


def us(column: str):
    return F.unix_micros(column)


def _until():
    return F.lit("2024-01-31").cast("timestamp")


_LOAD = """hb AS (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS node_id, max_by(struct_pack(q := l_quantity::INT, p := l_partkey::INT, o := l_orderkey, t := l_tax, f := l_returnflag, n := l_linenumber, ts := l_shipdate),
   struct_pack(a := l_shipdate, b := l_orderkey * 1000000 + l_partkey * 10 + l_linenumber)) AS h FROM lineitem GROUP BY 1),
 snap AS (SELECT m.node_id, cpu_cores, epoch_us(h.ts) AS ts_us, coalesce(h.q, 0) AS cpu_busy_pct, coalesce(h.p, 0)::BIGINT AS ram_used_mb,
   CASE WHEN h.o % 2 = 0 THEN h.o % 4096 + 1 ELSE m.ram_total_mb END AS ram_total_mb, coalesce(greatest(h.n, h.q % 5), 0) AS reported_inflight, coalesce(h.t = 0.08, false) AS paused, coalesce(h.f = 'R', false) AS on_battery, m.n_regionkey
   FROM manifests m LEFT JOIN hb USING (node_id))"""


def _snapshot(spark, d):
    li = read_sample(spark, d, "lineitem")
    n = F.col("l_quantity").cast("int") % 5
    beats = li.select(
        b.pad("l_suppkey", 6).alias("node_id"),
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").alias("queue_depth"),
        F.col("l_quantity").cast("int").alias("cpu_busy_pct"),
        F.col("l_partkey").alias("ram_used_mb"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 4096 + 1).otherwise(0).alias("ram_total_mb"),
        F.array_repeat(F.lit("task"), n).alias("in_flight"),
        (F.col("l_tax") == 0.08).alias("paused"),
        (F.col("l_returnflag") == "R").alias("on_battery"),
    )
    return te.peer_snapshot(beats, b.manifests(spark, d))


@query(
    "peer_snapshot_d18",
    f"{ctes('manifests')}, {_LOAD} SELECT node_id, cpu_cores, ts_us, cpu_busy_pct, ram_used_mb, ram_total_mb, reported_inflight, paused, on_battery FROM snap",
)
def peer_snapshot_d18(spark, d):
    return _snapshot(spark, d).withColumn("ts_us", us("ts")).drop("ts")


@query(
    "fleet_stats_k3",
    f"""{ctes('manifests')}, {_LOAD} SELECT os, count(*) AS nodes, sum(cpu_cores)::BIGINT AS cpu_cores, sum(ram_total_mb)::BIGINT AS ram_total_mb, sum(ram_used_mb)::BIGINT AS ram_used_mb,
    round(avg(cpu_busy_pct), 6) AS avg_cpu_busy_pct, max(cpu_busy_pct)::BIGINT AS max_cpu_busy_pct, sum(reported_inflight)::BIGINT AS inflight, count(*) FILTER (paused) AS paused_nodes
    FROM (SELECT s.*, coalesce(m.os, 'other') AS os FROM snap s JOIN (SELECT node_id, os FROM manifests) m USING (node_id)) GROUP BY os""",
)
def fleet_stats_k3(spark, d):
    os = b.manifests(spark, d).select("node_id", F.coalesce("os", F.lit("other")).alias("os"))
    return te.fleet_stats(_snapshot(spark, d).join(os, "node_id"), "os").withColumn("avg_cpu_busy_pct", F.round("avg_cpu_busy_pct", 6))


_MOVES = "mv AS (SELECT seq AS arrival, node_id, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'evicted' WHEN 'purchase' THEN 'leader_changed' ELSE 'updated' END AS kind, k AS payload FROM heartbeats)"


def _moves(spark, d):
    h = b.heartbeats(spark, d)
    kind = F.coalesce(b.choose("event_type", {"signup": "added", "error": "evicted", "purchase": "leader_changed"}), F.lit("updated"))
    return h.select(F.col("seq").alias("arrival"), "node_id", kind.alias("kind"), F.col("k").alias("payload"))


@query(
    "membership_snapshot_d20",
    f"{BEATS}, {_MOVES} SELECT node_id, arrival, payload FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY arrival DESC) AS r FROM mv WHERE kind <> 'leader_changed') WHERE r = 1 AND kind <> 'evicted'",
)
def membership_snapshot_d20(spark, d):
    return te.membership_snapshot(_moves(spark, d))


@query("current_leader_d20", f"{BEATS}, {_MOVES} SELECT max_by(node_id, arrival) AS leader, max(arrival) AS arrival FROM mv WHERE kind = 'leader_changed'")
def current_leader_d20(spark, d):
    return te.current_leader(_moves(spark, d))


@query(
    "ring_tail_e22",
    """SELECT conv_id AS task_id, seq, stream, line, dropped FROM (SELECT conv_id, turn AS seq, role AS stream, text AS line,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, greatest(count(*) OVER (PARTITION BY conv_id) - 3, 0) + 2 * count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS dropped FROM conversations) WHERE r <= 3""",
)
def ring_tail_e22(spark, d):
    c = read_sample(spark, d, "conversations")
    frames = c.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.col("role").alias("stream"), F.col("text").alias("line"))
    reported = frames.filter(F.col("stream") == "system").select("task_id", F.lit(2).cast("long").alias("n"))
    return te.ring_tail(frames, 3, reported)


_FRAMES = """fr AS (SELECT 't' || user_id AS task_id, event_id AS seq, CASE
   WHEN event_type = 'click' THEN '{"step":{"id":"s' || (k % 7) || '","state":"in_flight"}}'
   WHEN event_type = 'view' AND k % 4 = 0 THEN '{"completed":' || k || ',"total":120}'
   WHEN event_type = 'view' THEN 'not json {' WHEN event_type = 'error' THEN '{"step":{"id":"s' || (k % 7) || '","state":"failed"}}'
   WHEN event_type = 'purchase' THEN '{"step":{"id":"s' || (k % 7) || '","state":"done"}}'
   WHEN k = 50 THEN '{"plan_summary":{"ok":1}}' ELSE '[1]' END AS line, event_type, k, user_id FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
 kind AS (SELECT *, CASE WHEN event_type IN ('click', 'error', 'purchase') AND user_id % 3 > 0 THEN 'steps' WHEN event_type = 'signup' AND k = 50 THEN 'summary' WHEN event_type = 'view' AND k % 4 = 0 THEN 'count' END AS kind FROM fr),
 st AS (SELECT task_id, count(*) FILTER (settled) AS settled_steps, count(*) AS steps_seen FROM (SELECT task_id, k % 7 AS s, bool_or(event_type <> 'click') AS settled FROM fr WHERE event_type IN ('click', 'error', 'purchase') GROUP BY ALL) GROUP BY task_id),
 la AS (SELECT task_id, max_by(struct_pack(kind := kind, k := k), seq) FILTER (kind IS NOT NULL) AS last, any_value(user_id) AS user_id FROM kind GROUP BY task_id)"""


@query(
    "progress_e23",
    f"""WITH {_FRAMES} SELECT task_id, coalesce(settled_steps, 0) AS settled_steps, coalesce(steps_seen, 0) AS steps_seen,
    round(CASE last.kind WHEN 'steps' THEN least(1.0, settled_steps / 8.0) WHEN 'summary' THEN 1.0 WHEN 'count' THEN least(1.0, last.k / 120.0) END, 6) AS fraction FROM la LEFT JOIN st USING (task_id)""",
)
def progress_e23(spark, d):
    e = read_sample(spark, d, "events").withColumn("k", b.k_of())
    k = F.col("k").cast("string")
    s = (F.col("k") % 7).cast("string")
    kind = F.col("event_type")
    step = lambda state: F.concat(F.lit('{"step":{"id":"s'), s, F.lit(f'","state":"{state}"}}}}'))
    line = (
        F.when(kind == "click", step("in_flight"))
        .when((kind == "view") & (F.col("k") % 4 == 0), F.concat(F.lit('{"completed":'), k, F.lit(',"total":120}')))
        .when(kind == "view", "not json {")
        .when(kind == "error", step("failed"))
        .when(kind == "purchase", step("done"))
        .when(F.col("k") == 50, '{"plan_summary":{"ok":1}}')
        .otherwise("[1]")
    )
    task = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    partials = e.select(task.alias("task_id"), F.col("event_id").alias("seq"), line.alias("line"))
    sizes = e.select(task.alias("task_id"), F.when(F.col("user_id") % 3 > 0, 8).otherwise(0).alias("plan_size")).distinct()
    return te.progress(partials, sizes).withColumn("fraction", F.round("fraction", 6))


@query(
    "distinct_subjects_capped_d17",
    f"{BEATS} SELECT event_type, node_id, least(n, 8) AS distinct_subjects, n > 8 AS distinct_subjects_capped FROM (SELECT event_type, node_id, count(DISTINCT k) AS n FROM heartbeats GROUP BY ALL)",
)
def distinct_subjects_capped_d17(spark, d):
    h = b.heartbeats(spark, d).select("event_type", "node_id", F.col("k").cast("string").alias("subject"))
    return te.distinct_subjects_capped(h, ["event_type", "node_id"], 8)


@query(
    "success_rate_e26",
    f"""{ctes('heartbeats', recursive=True)}, o AS (SELECT node_id, event_type <> 'error' AND event_type <> 'view' AS ok, row_number() OVER (PARTITION BY node_id ORDER BY ts, seq) AS n FROM heartbeats),
    f AS (SELECT node_id, 0::BIGINT AS n, 1.0::DOUBLE AS r FROM o WHERE n = 1 UNION ALL
      SELECT f.node_id, o.n, greatest(0.8::DOUBLE * f.r + CASE WHEN o.ok THEN 0.2::DOUBLE ELSE 0 END, 0.05::DOUBLE) FROM f JOIN o ON o.node_id = f.node_id AND o.n = f.n + 1)
    SELECT node_id, round(max_by(r, n), 9) AS success_rate FROM f GROUP BY node_id""",
)
def success_rate_e26(spark, d):
    h = b.heartbeats(spark, d)
    outcomes = h.select("node_id", F.col("ts").alias("at"), F.col("seq").alias("outcome_id"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return te.success_rate(outcomes).withColumn("success_rate", F.round("success_rate", 9))


_TICKS = "tk AS (SELECT event_type AS observer, epoch_us(ts) // 21600000000 AS tick, node_id, max(k) AS score FROM heartbeats GROUP BY ALL)"


def _ticks(spark, d):
    h = b.heartbeats(spark, d)
    tick = F.floor(us("ts") / F.lit(21_600_000_000))
    return h.groupBy(F.col("event_type").alias("observer"), tick.alias("tick"), "node_id").agg(F.max("k").alias("score"))


@query(
    "leader_by_tick_e28",
    f"""{BEATS}, {_TICKS}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observer, tick ORDER BY score DESC, node_id) AS r FROM tk) WHERE r = 1)
    SELECT observer, tick, node_id AS leader, score, lag(node_id) OVER (PARTITION BY observer ORDER BY tick) IS DISTINCT FROM node_id AS changed FROM w""",
)
def leader_by_tick_e28(spark, d):
    return te.leader_by_tick(_ticks(spark, d))


@query(
    "leader_with_antiflap_g6",
    f"""{ctes('heartbeats', recursive=True)}, {_TICKS}, c AS (SELECT observer, tick * 21600 AS t, node_id, score * 4 AS s, dense_rank() OVER (PARTITION BY observer ORDER BY tick) AS n FROM tk),
    e AS (SELECT observer, t, n, node_id, s, row_number() OVER (PARTITION BY observer, t ORDER BY s DESC, node_id) AS r FROM c),
    two AS (SELECT observer, t, n, max(node_id) FILTER (r = 1) AS a, max(s) FILTER (r = 1) AS sa, max(node_id) FILTER (r = 2) AS z, max(s) FILTER (r = 2) AS sz FROM e WHERE r <= 2 GROUP BY ALL),
    f AS (SELECT observer, 0::BIGINT AS n, 0::BIGINT AS t, NULL::VARCHAR AS leader, 0::BIGINT AS score, false AS changed, NULL::VARCHAR AS demoted, NULL::BIGINT AS dat FROM two GROUP BY observer
      UNION ALL SELECT observer, n, t, w, ws, coalesce(leader <> w, true), CASE WHEN leader <> w THEN leader ELSE demoted END, CASE WHEN leader <> w THEN t ELSE dat END FROM (
        SELECT g.*, CASE WHEN first THEN a ELSE z END AS w, CASE WHEN first THEN pa ELSE pz END AS ws FROM (
          SELECT *, pz IS NULL OR pa > pz OR (pa = pz AND a < z) AS first FROM (
          SELECT f.observer, two.n, two.t, a, z, leader, demoted, dat, sa - CASE WHEN dat IS NOT NULL AND two.t - dat < 43200 AND demoted = a THEN 50 ELSE 0 END AS pa,
            sz - CASE WHEN dat IS NOT NULL AND two.t - dat < 43200 AND demoted = z THEN 50 ELSE 0 END AS pz FROM f JOIN two ON two.observer = f.observer AND two.n = f.n + 1)) g))
    SELECT observer, t * 1000 AS tick_ms, leader, score, changed FROM f WHERE n > 0""",
)
def leader_with_antiflap_g6(spark, d):
    t = _ticks(spark, d).select("observer", (F.col("tick") * 21_600_000).alias("tick_ms"), "node_id", (F.col("score") * 4).alias("score"))
    return te.leader_with_antiflap(t, 43_200_000, 50)


@query("reject_replays_g1", f"""{BEATS}, f AS (SELECT node_id, event_type AS channel, seq AS arrival, k AS seq FROM heartbeats)
    SELECT *, coalesce(seq > last_seen, true) AS accepted FROM (SELECT *, max(seq) OVER (PARTITION BY node_id, channel ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seen FROM f)""")
def reject_replays_g1(spark, d):
    h = b.heartbeats(spark, d)
    return te.reject_replays(h.select("node_id", F.col("event_type").alias("channel"), F.col("seq").alias("arrival"), F.col("k").alias("seq")))


@query(
    "liveness_g2",
    f"{BEATS} SELECT node_id, epoch_us(max(ts)) AS last_us, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) < 86400000000 AS live FROM heartbeats GROUP BY node_id",
)
def liveness_g2(spark, d):
    out = te.liveness(b.heartbeats(spark, d), _until(), 86_400_000)
    return out.select("node_id", us("last_ts").alias("last_us"), "live")


@query(
    "membership_events_g3",
    f"""{BEATS}, p AS (SELECT node_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY node_id ORDER BY ts, seq) AS b FROM heartbeats)
    SELECT node_id, CASE WHEN b IS NULL OR t - b >= 86400000000 THEN 'added' ELSE 'updated' END AS kind, t AS at_us FROM p
    UNION ALL SELECT node_id, 'evicted', b + 86400000000 FROM p WHERE t - b >= 86400000000
    UNION ALL SELECT node_id, 'evicted', max(t) + 86400000000 FROM p GROUP BY node_id HAVING epoch_us(TIMESTAMP '2024-01-31') - max(t) >= 86400000000""",
)
def membership_events_g3(spark, d):
    out = te.membership_events(b.heartbeats(spark, d), _until(), 86_400_000)
    return out.select("node_id", "kind", us("at").alias("at_us"))


@query(
    "pause_latch_g7",
    f"""{BEATS} SELECT node_id, seq, depth, coalesce(last_value(flip IGNORE NULLS) OVER w, false) AS latched, coalesce(last_value(flip IGNORE NULLS) OVER w, false) OR op AS paused
    FROM (SELECT *, load AS depth, CASE WHEN load >= 100 THEN true WHEN load <= 10 THEN false END AS flip, k = 99 AS op FROM heartbeats) WINDOW w AS (PARTITION BY node_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""",
)
def pause_latch_g7(spark, d):
    h = b.heartbeats(spark, d)
    depths = h.select("node_id", F.col("ts").alias("at"), "seq", F.col("load").alias("depth"), (F.col("k") == 99).alias("operator_pause"))
    return te.pause_latch(depths, 100, 10).select("node_id", "seq", "depth", "latched", "paused")


@query(
    "dedup_deliveries_g10",
    f"""{ctes('messages')}, m AS (SELECT arrival, CASE WHEN turn = 1 THEN '' ELSE 'm' || (conv_id // 2) || '-' || turn END AS message_id, conv_id FROM messages)
    SELECT message_id, arrival, conv_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY arrival) AS r FROM m) WHERE r = 1 OR message_id = ''""",
)
def dedup_deliveries_g10(spark, d):
    m = b.messages(spark, d)
    key = F.concat(F.lit("m"), F.expr("conv_id div 2").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return te.dedup_deliveries(m.select(F.when(F.col("turn") == 1, "").otherwise(key).alias("message_id"), "arrival", "conv_id"))


_OUT = "o AS (SELECT node_id, ts, seq, event_type NOT IN ('error', 'view', 'click') AS ok FROM heartbeats)"


def _outcomes(spark, d):
    h = b.heartbeats(spark, d)
    return h.select("node_id", F.col("ts").alias("at"), F.col("seq").alias("outcome_id"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))


@query(
    "failure_streaks_g13",
    f"""{BEATS}, {_OUT}, i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY node_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT node_id, island, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS failures FROM i WHERE NOT ok GROUP BY node_id, island""",
)
def failure_streaks_g13(spark, d):
    out = te.failure_streaks(_outcomes(spark, d))
    return out.select("node_id", F.col("island").cast("long").alias("island"), us("first_at").alias("first_us"), us("last_at").alias("last_us"), "failures")


@query(
    "breaker_g13",
    f"""{ctes('heartbeats', recursive=True)}, {_OUT}, n AS (SELECT node_id, epoch_us(ts) AS t, ok, row_number() OVER (PARTITION BY node_id ORDER BY ts, seq) AS n FROM o),
    f AS (SELECT DISTINCT node_id, 0::BIGINT AS n, 0::BIGINT AS t, 0 AS fails, NULL::BIGINT AS until, NULL::BIGINT AS trip, true AS ok FROM n UNION ALL
      SELECT f.node_id, n.n, n.t, CASE WHEN n.ok THEN 0 WHEN until <= n.t THEN 1 ELSE fails + 1 END,
        CASE WHEN n.ok THEN NULL WHEN CASE WHEN until <= n.t THEN 1 ELSE fails + 1 END >= 3 THEN n.t + 43200000000 END,
        CASE WHEN n.ok THEN NULL WHEN until <= n.t THEN NULL WHEN fails + 1 = 3 THEN n.t WHEN fails + 1 > 3 THEN trip END, n.ok FROM f JOIN n ON n.node_id = f.node_id AND n.n = f.n + 1),
    s AS (SELECT *, lead(fails) OVER w AS nf, lead(t) OVER w AS nt, lead(ok) OVER w AS nok FROM f WINDOW w AS (PARTITION BY node_id ORDER BY n))
    SELECT node_id, trip AS benched_us, CASE WHEN nok THEN least(until, nt) ELSE until END AS until_us, fails::BIGINT AS failures FROM s WHERE trip IS NOT NULL AND (nf IS NULL OR nf <= 1)""",
)
def breaker_g13(spark, d):
    out = te.breaker(_outcomes(spark, d), 3, 43_200_000)
    return out.select("node_id", us("benched_at").alias("benched_us"), us("benched_until").alias("until_us"), "failures")


@query(
    "windowed_load_g14",
    f"""{BEATS}, s AS (SELECT node_id, unnest([epoch_us(ts) // 21600000000 * 21600, epoch_us(ts) // 21600000000 * 21600 - 21600]) AS w, load FROM heartbeats)
    SELECT node_id, w AS window_start_s, count(*) AS beats, round(avg(load), 6) AS avg_load, max(load) AS max_load FROM s GROUP BY node_id, w""",
)
def windowed_load_g14(spark, d):
    out = te.windowed_load(b.heartbeats(spark, d), "12 hours", "6 hours")
    return out.select("node_id", F.unix_seconds("window_start").alias("window_start_s"), "beats", F.round("avg_load", 6).alias("avg_load"), "max_load")


def _first_windows(keys: str, source: str, window: int) -> str:
    """Windows opened one after another, as a recursive walk over each key's records."""
    return f"""pt AS (SELECT DISTINCT {keys}, at_ms FROM {source}),
     op AS (SELECT {keys}, min(at_ms) AS w FROM pt GROUP BY ALL UNION ALL
       SELECT {keys}, w FROM (SELECT {", ".join("op." + k.strip() for k in keys.split(","))}, (SELECT min(pt.at_ms) FROM pt WHERE {" AND ".join(f"pt.{k.strip()} = op.{k.strip()}" for k in keys.split(","))} AND pt.at_ms >= op.w + {window}) AS w FROM op) WHERE w IS NOT NULL),
     placed AS (SELECT s.*, (SELECT max(op.w) FROM op WHERE {" AND ".join(f"op.{k.strip()} = s.{k.strip()}" for k in keys.split(","))} AND op.w <= s.at_ms) AS w FROM {source} s)"""


_BURST_WINDOW = 86_400_000
_BURSTS = """au AS (SELECT seq AS row_id, at_ms, action, actor, CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 13 = 0 THEN repeat('é' || chr(7), 60) || subject ELSE subject END AS subject FROM audit),
 fl AS (SELECT * FROM au WHERE action IN ('shell.denied', 'shell.allowed'))"""


@query(
    "suppress_bursts_g8",
    f"""{ctes('audit', recursive=True)}, {_BURSTS}, {_first_windows("action, actor", "fl", _BURST_WINDOW)},
    rk AS (SELECT *, row_number() OVER (PARTITION BY action, actor, w ORDER BY at_ms, row_id) AS r FROM placed),
    su AS (SELECT action, actor, w, count(*) AS n, count(DISTINCT subject) AS dist FROM rk WHERE r > 3 GROUP BY ALL)
    SELECT 'entry' AS kind, row_id, at_ms, action, actor, subject, w AS window_start_ms, NULL::BIGINT AS suppressed_repeats, NULL::BIGINT AS distinct_subjects, NULL::BOOLEAN AS distinct_subjects_capped FROM rk WHERE r <= 3
    UNION ALL SELECT 'entry', row_id, at_ms, action, actor, subject, NULL, NULL, NULL, NULL FROM au WHERE action NOT IN ('shell.denied', 'shell.allowed')
    UNION ALL SELECT 'summary', NULL, w + {_BURST_WINDOW}, action, actor, NULL, w, n, least(dist, 64), dist > 64 FROM su""",
)
def suppress_bursts_g8(spark, d):
    out = fr.suppress_bursts(_burst_rows(spark, d), _BURST_WINDOW, 3, ["shell.denied", "shell.allowed"])
    return out.drop("sample_subjects", "sample_dropped_for_size")


def _burst_rows(spark, d):
    a = b.audit(spark, d)
    seq = F.col("seq")
    long = F.concat(F.expr("repeat(concat('é', char(7)), 60)"), F.col("subject"))
    subject = F.when(seq % 17 == 0, F.lit(None).cast("string")).when(seq % 13 == 0, long).otherwise(F.col("subject"))
    return a.select(seq.alias("row_id"), "at_ms", "action", "actor", subject.alias("subject"))


@query(
    "suppress_bursts_samples_g8",
    f"""{ctes('audit', recursive=True)}, {_BURSTS}, {_first_windows("action, actor", "fl", _BURST_WINDOW)},
    rk AS (SELECT *, row_number() OVER (PARTITION BY action, actor, w ORDER BY at_ms, row_id) AS r FROM placed),
    gr AS (SELECT DISTINCT action, actor, w FROM rk WHERE r > 3),
    sj AS (SELECT action, actor, w, subject, min(r) AS first FROM rk WHERE r > 3 AND subject IS NOT NULL GROUP BY ALL),
    tx AS (SELECT *, replace(subject, chr(7), '·') AS f, row_number() OVER (PARTITION BY action, actor, w ORDER BY first) AS no FROM sj),
    sh AS (SELECT action, actor, w, list(CASE WHEN strlen(f) <= 128 THEN f ELSE left(f, 64) || '…' END ORDER BY no) AS s FROM tx WHERE no <= 8 GROUP BY ALL)
    SELECT action, actor, w AS window_start_ms, coalesce(to_json(s)::VARCHAR, '[]') AS samples, 0 AS sample_dropped_for_size FROM gr LEFT JOIN sh USING (action, actor, w)""",
)
def suppress_bursts_samples_g8(spark, d):
    out = fr.suppress_bursts(_burst_rows(spark, d), _BURST_WINDOW, 3, ["shell.denied", "shell.allowed"])
    return out.filter(F.col("kind") == "summary").select(
        "action", "actor", "window_start_ms", F.to_json("sample_subjects").alias("samples"), "sample_dropped_for_size"
    )


_RATE_WINDOW = 3 * 86_400_000


@query(
    "rate_limit_g9",
    f"""{ctes('audit', recursive=True)}, rq AS (SELECT actor AS key, at_ms, seq AS request_id FROM audit), {_first_windows("key", "rq", _RATE_WINDOW)},
    rk AS (SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY at_ms, request_id) AS r FROM placed),
    tot AS (SELECT key, w, greatest(count(*) - 20, 0) AS dropped FROM placed GROUP BY ALL), bf AS (SELECT *, lag(dropped) OVER (PARTITION BY key ORDER BY w) AS before FROM tot)
    SELECT rk.key, at_ms, request_id, rk.w AS window_start_ms, r <= 20 AS admitted, CASE WHEN r = 1 THEN coalesce(before, 0) WHEN r <= 20 THEN 0 END AS dropped_before FROM rk JOIN bf ON bf.key = rk.key AND bf.w = rk.w""",
)
def rate_limit_g9(spark, d):
    a = b.audit(spark, d)
    return fr.rate_limit(a.select(F.col("actor").alias("key"), "at_ms", F.col("seq").alias("request_id")), 20, _RATE_WINDOW)


@query(
    "coalesce_requests_g11",
    f"""{ctes('heartbeats', recursive=True)}, rq AS (SELECT event_type AS fingerprint, epoch_us(ts) // 1000 AS at_ms, seq AS request_id FROM heartbeats),
    ix AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY at_ms, request_id) AS i FROM rq),
    op AS (SELECT fingerprint, 1::BIGINT AS i, min(at_ms) AS w FROM ix GROUP BY fingerprint UNION ALL
      SELECT fingerprint, i, (SELECT at_ms FROM ix WHERE ix.fingerprint = z.fingerprint AND ix.i = z.i) FROM (
        SELECT op.fingerprint, (SELECT min(ix.i) FROM ix WHERE ix.fingerprint = op.fingerprint AND (ix.at_ms >= op.w + 86400000 OR ix.i >= op.i + 9)) AS i FROM op) z WHERE i IS NOT NULL),
    pl AS (SELECT ix.*, (SELECT max(op.i) FROM op WHERE op.fingerprint = ix.fingerprint AND op.i <= ix.i) AS batch_no FROM ix)
    SELECT request_id, fingerprint, at_ms, batch_no, first_value(at_ms) OVER w AS window_start_ms, count(*) OVER (PARTITION BY fingerprint, batch_no) AS batch_size,
      CASE WHEN count(*) OVER (PARTITION BY fingerprint, batch_no) >= 9 THEN 'full' ELSE 'window' END AS sent_by FROM pl WINDOW w AS (PARTITION BY fingerprint, batch_no ORDER BY i)""",
)
def coalesce_requests_g11(spark, d):
    h = b.heartbeats(spark, d)
    rq = h.select(F.col("event_type").alias("fingerprint"), F.unix_millis("ts").alias("at_ms"), F.col("seq").alias("request_id"))
    return fr.coalesce_requests(rq, 86_400_000, 9)


@query(
    "tumbling_batches_g11",
    f"{BEATS} SELECT event_type AS fingerprint, epoch_us(ts) // 3600000000 * 3600 AS window_s, count(*) AS batch_size FROM heartbeats GROUP BY ALL",
)
def tumbling_batches_g11(spark, d):
    h = b.heartbeats(spark, d)
    rq = h.select(F.col("event_type").alias("fingerprint"), F.unix_millis("ts").alias("at_ms"))
    return fr.tumbling_batches(rq, "1 hour").select("fingerprint", F.unix_seconds("window_start").alias("window_s"), "batch_size")
