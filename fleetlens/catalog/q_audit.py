"""Queries: hash-chained audit logs and pinned heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes, sql_hash
from fleetlens.catalog.registry import query
from fleetlens.operators import audit as au
from fleetlens.operators import pins as pn
from fleetlens.vocab import AUDIT_ACTIONS, NOTABLE_ACTIONS

AUDIT = ctes("audit")
CHAIN = ctes("links", "chain", "chained", recursive=True)
PINS = ctes("links", "chain", "chained", "pins", recursive=True)
RUNS = ctes("links", "chain", "chained", "pins", "runs", recursive=True)
_IN = lambda names: ", ".join(f"'{n}'" for n in names)


@query(
    "audit_filter_b8",
    f"{AUDIT} SELECT node_id, seq, at_ms, action, actor FROM audit WHERE action = 'shell.denied' AND starts_with(actor, 'peer:1') AND at_ms >= 1704326400000 AND at_ms < 1705622400000",
)
def audit_filter_b8(spark, d):
    out = au.audit_filter(b.audit(spark, d), "shell.denied", None, "peer:1", 1704326400000, 1705622400000)
    return out.select("node_id", "seq", "at_ms", "action", "actor")


@query("flag_notable_b9", f"{AUDIT} SELECT node_id, seq, action, action IN ({_IN(NOTABLE_ACTIONS)}) AS notable FROM audit")
def flag_notable_b9(spark, d):
    return au.flag_notable(b.audit(spark, d)).select("node_id", "seq", "action", "notable")


@query(
    "suppression_rows_b15",
    f"""{AUDIT} SELECT node_id, seq, action, (detail->>'$.suppressed_repeats')::DOUBLE AS repeats, coalesce((detail->>'$.distinct_subjects')::DOUBLE, 0) AS distinct_subjects,
    (detail->>'$.window_start_ms')::DOUBLE AS since_ms FROM audit WHERE json_type(detail, '$.suppressed_repeats') IN ('UBIGINT', 'BIGINT', 'DOUBLE')""",
)
def suppression_rows_b15(spark, d):
    return au.suppression_rows(b.audit(spark, d))


@query(
    "find_forks_c16",
    """WITH h AS (SELECT 'u' || user_id AS node_id, (props->>'$.k')::BIGINT AS seq, sha256(event_type) AS entry_hash, min(epoch_us(ts) // 1000) AS seen FROM events GROUP BY ALL),
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, seq ORDER BY seen, entry_hash) AS r FROM h) WHERE r = 1)
    SELECT h.node_id, h.seq, held.entry_hash AS held_hash, h.entry_hash AS other_hash FROM h JOIN held USING (node_id, seq) WHERE h.entry_hash <> held.entry_hash""",
)
def find_forks_c16(spark, d):
    from fleetlens.sources.tables import read_sample

    e = read_sample(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node_id"),
        b.k_of().alias("seq"),
        F.sha2("event_type", 256).alias("entry_hash"),
        F.unix_millis("ts").alias("at_ms"),
    )
    return au.find_forks(rows)


_SOUND = f"action IN ({_IN(AUDIT_ACTIONS)}) AND entry_hash = {sql_hash('chained', 'chained.prev_hash')}"
_LINKED = f"""linked AS (SELECT *, {_SOUND} AS sound, lag(seq) OVER w AS pseq, lag(entry_hash) OVER w AS phash FROM chained WINDOW w AS (PARTITION BY node_id ORDER BY seq)),
 marked AS (SELECT *, CASE WHEN pseq IS NOT NULL THEN pseq + 1 = seq AND phash = prev_hash END AS ok FROM linked),
 segments AS (SELECT *, max(CASE WHEN NOT sound THEN seq + 1 WHEN NOT coalesce(ok, false) THEN seq END) OVER (PARTITION BY node_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment_start FROM marked)"""
_VERIFIED = f"""{_LINKED}, verdict AS (SELECT node_id, min(seq) AS from_seq, max(seq) AS head_seq, min(seq) FILTER (NOT sound OR NOT coalesce(ok, true)) AS broken_at_seq, count(*) AS entries FROM marked GROUP BY node_id)"""


@query("entry_hash_e5", f"{CHAIN} SELECT node_id, seq, entry_hash, {sql_hash('chained', 'chained.prev_hash')} AS computed_hash FROM chained")
def entry_hash_e5(spark, d):
    return au.entry_hashes(b.chained(spark, d))


@query(
    "verify_chain_e3",
    f"{CHAIN}, {_VERIFIED} SELECT *, CASE WHEN broken_at_seq IS NULL THEN head_seq END AS through_seq FROM verdict",
)
def verify_chain_e3(spark, d):
    return au.verify_chain(b.chained(spark, d))


_FIRST = "first AS (SELECT node_id, seq, prev_hash FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS r FROM {t}) WHERE r = 1)"
_ANCHOR = """anchors AS (SELECT f.node_id, f.seq, CASE WHEN f.seq = 1 AND f.prev_hash = repeat('0', 64) THEN 'genesis' WHEN f.seq = 1 THEN 'unanchored'
  WHEN s.entry_hash = f.prev_hash THEN 'predecessor'
  WHEN s.entry_hash IS NULL AND EXISTS (SELECT 1 FROM {t} m WHERE m.node_id = f.node_id AND m.action = 'audit.truncated' AND (m.detail->>'$.through_seq')::BIGINT = f.seq - 1 AND m.detail->>'$.through_hash' = f.prev_hash) THEN 'marker'
  WHEN p.entry_hash = f.prev_hash THEN 'pin' ELSE 'unanchored' END AS anchor
  FROM {f} f LEFT JOIN {t} s ON s.node_id = f.node_id AND s.seq = f.seq - 1 LEFT JOIN pins p ON p.node_id = f.node_id AND p.seq = f.seq - 1)"""

# Deleting the start of some chains leaves them anchored by a pin, or not at all.
_CUT = "cut AS (SELECT * FROM chained WHERE seq > (CASE WHEN event_id // 64 % 2 = 0 THEN 0 ELSE 10 + event_id // 64 % 7 END))"


def _cut(spark, d, c=None):
    block = F.expr("event_id div 64")
    start = F.when(block % 2 == 0, 0).otherwise(10 + block % 7)
    return b.chained(spark, d, c).filter(F.col("seq") > start)


@query("anchor_check_e4", f"{PINS}, {_CUT}, {_FIRST.format(t='cut')}, {_ANCHOR.format(t='cut', f='first')} SELECT * FROM anchors")
def anchor_check_e4(spark, d):
    c = b.stored_chain(spark, d)
    return au.anchor_check(_cut(spark, d, c), b.pins(spark, d, c))


_KEEP, _AT = 40, 1706745600000
_MARKER_HASH = f"""sha256('{{"action":"audit.truncated","actor":"system","at":{_AT},"detail":' || to_json(detail) || ',"node":' || to_json(node_id) || ',"prev":' || to_json(prev_hash) || ',"seq":' || seq || ',"subject":null}}')"""
_PRUNED = f"""heads AS (SELECT node_id, max(seq) AS head, max_by(entry_hash, seq) AS head_hash FROM chained GROUP BY node_id HAVING max(seq) > {_KEEP}),
 cuts AS (SELECT h.*, head - {_KEEP} AS cut_seq, c.entry_hash AS cut_hash FROM heads h JOIN chained c ON c.node_id = h.node_id AND c.seq = head - {_KEEP}),
 m AS (SELECT node_id, head + 1 AS seq, '{{"through_hash":"' || cut_hash || '","through_seq":' || cut_seq || '}}' AS detail, head_hash AS prev_hash FROM cuts),
 pruned AS (SELECT c.node_id, c.seq, c.at_ms, c.action, c.subject, c.detail, c.actor, c.prev_hash, c.entry_hash FROM chained c LEFT JOIN cuts k ON k.node_id = c.node_id WHERE k.cut_seq IS NULL OR c.seq > k.cut_seq
  UNION ALL SELECT node_id, seq, {_AT}, 'audit.truncated', NULL, detail, 'system', prev_hash, {_MARKER_HASH} FROM m)"""

_COLUMNS = ["node_id", "seq", "at_ms", "action", "subject", "detail", "actor", "prev_hash", "entry_hash"]


def _pruned(spark, d, c):
    rows = b.chained(spark, d, c).select(*_COLUMNS, "received_at_ms")
    return au.prune_with_marker(rows, _KEEP, _AT)


@query("prune_with_marker_e6", f"{CHAIN}, {_PRUNED} SELECT * FROM pruned")
def prune_with_marker_e6(spark, d):
    return _pruned(spark, d, b.stored_chain(spark, d)).select(*_COLUMNS)


@query(
    "anchor_after_prune_e4",
    f"{PINS}, {_PRUNED}, {_FIRST.format(t='pruned')}, {_ANCHOR.format(t='pruned', f='first')} SELECT * FROM anchors",
)
def anchor_after_prune_e4(spark, d):
    c = b.stored_chain(spark, d)
    return au.anchor_check(_pruned(spark, d, c), b.pins(spark, d, c).filter(F.lit(True)))


@query(
    "audit_feed_e7",
    f"""{AUDIT} SELECT node_id, seq, action, coalesce(received_at_ms, at_ms) AS feed_ms FROM audit
    WHERE (coalesce(received_at_ms, at_ms), node_id, seq) < (1705622400000, 'u000075', 5000) ORDER BY feed_ms DESC, node_id DESC, seq DESC LIMIT 250""",
)
def audit_feed_e7(spark, d):
    return au.audit_feed(b.audit(spark, d), (1705622400000, "u000075", 5000), 250).select("node_id", "seq", "action", "feed_ms")


@query(
    "page_verification_e8",
    f"""{CHAIN}, {_LINKED}, page AS (SELECT node_id, min(seq) AS from_seq, max(seq) AS page_max_seq FROM chained WHERE action = 'shell.denied' GROUP BY node_id),
    walked AS (SELECT p.*, min(m.seq) FILTER (NOT sound OR (NOT coalesce(ok, true) AND m.seq > from_seq)) AS broken_at_seq, max(m.seq) AS reached
      FROM page p JOIN marked m ON m.node_id = p.node_id AND m.seq BETWEEN from_seq AND from_seq + 29 GROUP BY ALL)
    SELECT node_id, from_seq, page_max_seq, broken_at_seq, CASE WHEN broken_at_seq IS NULL THEN reached END AS through_seq,
    CASE WHEN broken_at_seq IS NOT NULL THEN 'broken' WHEN reached < page_max_seq THEN 'warn' ELSE 'ok' END AS tone FROM walked""",
)
def page_verification_e8(spark, d):
    c = b.chained(spark, d)
    return au.page_verification(c.filter(F.col("action") == "shell.denied"), c, 30)


@query(
    "thin_pins_e9",
    f"""{PINS}, r AS (SELECT pin_no FROM (SELECT pin_no, row_number() OVER (PARTITION BY node_id ORDER BY first_seen_ms DESC, pin_no DESC) AS n FROM pins WHERE status = 'unchecked') WHERE n <= 3),
    g AS (SELECT min(pin_no) FROM pins GROUP BY node_id, first_seen_ms // 7200000), o AS (SELECT min(pin_no) FROM pins GROUP BY node_id)
    SELECT pin_no, node_id, seq, status FROM pins WHERE status <> 'unchecked' OR pin_no IN (FROM r) OR pin_no IN (FROM g) OR pin_no IN (FROM o)""",
)
def thin_pins_e9(spark, d):
    return pn.thin_pins(b.pins(spark, d), 3, 7_200_000).select("pin_no", "node_id", "seq", "status")


@query(
    "next_pin_e10",
    f"{PINS} SELECT node_id, seq, pin_no FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY first_seen_ms DESC, seq) AS r FROM pins) WHERE r = 1",
)
def next_pin_e10(spark, d):
    return pn.next_pin(b.pins(spark, d)).select("node_id", "seq", "pin_no")


@query(
    "relay_heads_e11",
    f"""{PINS} SELECT node_id, seq, observed_at_ms FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY first_seen_ms DESC, seq DESC) AS r FROM pins) WHERE r = 1
    ORDER BY observed_at_ms DESC, node_id LIMIT 16""",
)
def relay_heads_e11(spark, d):
    return pn.relay_heads(b.pins(spark, d)).select("node_id", "seq", "observed_at_ms")


_OFFER = """offered AS (SELECT *, node_id || CASE WHEN seq <= 32 THEN '/a' ELSE '/b' END AS batch_id FROM chained WHERE NOT (event_type = 'click' AND k = 2)),
 edited AS (SELECT batch_id, node_id, seq, CASE WHEN event_type = 'click' AND k = 3 THEN at_ms + 200000000000 ELSE at_ms END AS at_ms,
  CASE WHEN event_type = 'click' AND k = 4 THEN 'task.unknown' ELSE action END AS action, subject,
  CASE WHEN event_type = 'click' AND k = 5 THEN repeat('d', 5000) ELSE detail END AS detail, actor, CASE WHEN event_type = 'click' AND k = 6 THEN repeat('1', 64) ELSE prev_hash END AS prev_hash, entry_hash FROM offered)"""


@query(
    "validate_ingest_e12",
    f"""{CHAIN}, {_OFFER}, o AS (SELECT *, lag(seq) OVER w AS pseq, lag(entry_hash) OVER w AS phash, {sql_hash('edited', 'edited.prev_hash')} AS computed FROM edited
      WINDOW w AS (PARTITION BY batch_id ORDER BY seq))
    SELECT batch_id, node_id, seq, CASE WHEN node_id = 'n00000003' THEN 'own_chain' WHEN pseq + 1 <> seq THEN 'gap' WHEN at_ms > 1706745600000 + 86400000 THEN 'skew'
      WHEN strlen(detail) > 4096 THEN 'detail_too_large' WHEN strlen(subject) > 1048576 THEN 'subject_too_large'
      WHEN seq > CASE WHEN batch_id LIKE '%/a' THEN 30 ELSE 60 END THEN 'past_target' WHEN action NOT IN ({_IN(AUDIT_ACTIONS)}) THEN 'unknown_action'
      WHEN computed <> entry_hash THEN 'hash_mismatch' WHEN phash <> prev_hash THEN 'broken_link' END AS reason FROM o""",
)
def validate_ingest_e12(spark, d):
    c = b.chained(spark, d)
    click = F.col("event_type") == "click"
    is_k = lambda n: click & (F.col("k") == n)
    rows = c.filter(~is_k(2)).withColumns(
        {
            "batch_id": F.concat(F.col("node_id"), F.when(F.col("seq") <= 32, "/a").otherwise("/b")),
            "at_ms": F.when(is_k(3), F.col("at_ms") + 200_000_000_000).otherwise(F.col("at_ms")),
            "action": F.when(is_k(4), "task.unknown").otherwise(F.col("action")),
            "detail": F.when(is_k(5), F.lit("d" * 5000)).otherwise(F.col("detail")),
            "prev_hash": F.when(is_k(6), F.lit("1" * 64)).otherwise(F.col("prev_hash")),
        }
    )
    targets = rows.select("batch_id").distinct().withColumn("target_seq", F.when(F.endswith("batch_id", F.lit("/a")), 30).otherwise(60))
    return pn.validate_ingest(rows, targets, "n00000003", 1706745600000)


@query(
    "run_anchor_e13",
    f"""{RUNS}, batches AS (SELECT r.node_id || '@' || target_seq AS batch_id, r.node_id, target_seq, c.seq, CASE WHEN r.k % 9 = 0 THEN sha256('x') ELSE c.prev_hash END AS prev_hash, r.k
      FROM runs r JOIN chain c ON c.node_id = r.node_id AND c.seq = CASE WHEN r.k % 4 = 3 THEN r.through_seq - 5 ELSE r.through_seq + 1 END),
    known AS (SELECT * FROM runs WHERE k % 4 <> 2)
    SELECT x.batch_id, x.node_id, x.seq, CASE WHEN w.through_seq IS NOT NULL AND x.seq <> w.through_seq + 1 THEN 'not_contiguous'
      WHEN w.through_seq IS NOT NULL AND NOT coalesce(s.entry_hash = x.prev_hash, false) THEN 'broken_run_link'
      WHEN w.through_seq IS NULL AND x.seq > 1 AND NOT coalesce(s.entry_hash = x.prev_hash, false) AND NOT coalesce(p.entry_hash = x.prev_hash, false) THEN 'unanchored_start' ELSE 'ok' END AS verdict
    FROM batches x LEFT JOIN known w ON w.node_id = x.node_id AND w.target_seq = x.target_seq
    LEFT JOIN chained s ON s.node_id = x.node_id AND s.seq = coalesce(w.through_seq, x.seq - 1) LEFT JOIN pins p ON p.node_id = x.node_id AND p.seq = coalesce(w.through_seq, x.seq - 1)""",
)
def run_anchor_e13(spark, d):
    c = b.stored_chain(spark, d)
    r = b.runs(spark, d, c)
    firsts = c.select("node_id", "seq", "prev_hash")
    want = F.when(F.col("k") % 4 == 3, F.col("through_seq") - 5).otherwise(F.col("through_seq") + 1)
    batches = r.select("node_id", "target_seq", "k", want.alias("seq")).join(firsts, ["node_id", "seq"])
    batches = batches.select(
        F.concat_ws("@", "node_id", F.col("target_seq").cast("string")).alias("batch_id"),
        "node_id",
        "target_seq",
        "seq",
        F.when(F.col("k") % 9 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash")).alias("prev_hash"),
    )
    return pn.run_anchor(batches, r.filter(F.col("k") % 4 != 2), b.chained(spark, d, c), b.pins(spark, d, c))


@query(
    "corroborate_e14",
    f"""{RUNS}, {_LINKED}, starts AS (SELECT DISTINCT c.node_id, c.seq, c.prev_hash FROM chained c JOIN runs r ON r.node_id = c.node_id AND r.from_seq = c.seq), {_ANCHOR.format(t='chained', f='starts')}
    SELECT p.node_id, p.seq, CASE WHEN p.status = 'contradicted' THEN 'contradicted'
      WHEN r.complete AND r.through_seq = p.seq AND s.entry_hash = p.entry_hash AND s.sound AND s.segment_start <= r.from_seq AND a.anchor <> 'unanchored' THEN 'corroborated' ELSE 'unchecked' END AS status
    FROM pins p LEFT JOIN runs r ON r.node_id = p.node_id AND r.target_seq = p.seq LEFT JOIN segments s ON s.node_id = p.node_id AND s.seq = p.seq
    LEFT JOIN anchors a ON a.node_id = p.node_id AND a.seq = r.from_seq""",
)
def corroborate_e14(spark, d):
    c = b.stored_chain(spark, d)
    return pn.corroborate(b.pins(spark, d, c), b.chained(spark, d, c), b.runs(spark, d, c))


_HEADS = """heads AS (SELECT event_id AS head_no, 'u' || (user_id % 40) AS node_id, (event_id * 7919) % 500 AS seq, sha256(event_type) AS entry_hash FROM events),
 held AS (SELECT 'u' || (o_custkey % 40) AS node_id, o_orderkey % 300 AS seq, min(sha256(CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE 'view' END)) AS entry_hash FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 300 > 0 GROUP BY 1, 2)"""


@query(
    "classify_pins_e15",
    f"""WITH {_HEADS}, f AS (SELECT node_id, seq, min(head_no) AS first_no, min_by(entry_hash, head_no) AS first_hash FROM heads WHERE seq > 0 GROUP BY ALL),
    hm AS (SELECT node_id, max(seq) AS held_max FROM held GROUP BY node_id),
    v AS (SELECT *, max(seq) OVER (PARTITION BY node_id ORDER BY head_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS batch_max FROM heads WHERE seq > 0),
    j AS (SELECT v.*, coalesce(h.entry_hash, CASE WHEN head_no > first_no THEN first_hash END) AS known, greatest(held_max, batch_max) AS top
      FROM v LEFT JOIN held h ON h.node_id = v.node_id AND h.seq = v.seq JOIN f ON f.node_id = v.node_id AND f.seq = v.seq LEFT JOIN hm ON hm.node_id = v.node_id)
    SELECT head_no, node_id, seq, CASE WHEN known = entry_hash THEN 'refreshed' WHEN known IS NOT NULL THEN 'fork' WHEN seq < top THEN 'stale_pinned' ELSE 'pinned' END AS outcome FROM j
    UNION ALL SELECT head_no, node_id, seq, 'rejected_seq' FROM heads WHERE seq <= 0""",
)
def classify_pins_e15(spark, d):
    from fleetlens.sources.tables import read_sample

    e, o = read_sample(spark, d, "events"), read_sample(spark, d, "orders")
    u = lambda c: F.concat(F.lit("u"), (F.col(c) % 40).cast("string"))
    heads = e.select(
        F.col("event_id").alias("head_no"), u("user_id").alias("node_id"), (F.col("event_id") * 7919 % 500).alias("seq"), F.sha2("event_type", 256).alias("entry_hash")
    )
    h = F.sha2(F.when(F.col("o_orderkey") % 2 == 0, "click").otherwise("view"), 256)
    held = (
        o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 300 > 0))
        .groupBy(u("o_custkey").alias("node_id"), (F.col("o_orderkey") % 300).alias("seq"))
        .agg(F.min(h).alias("entry_hash"))
    )
    return pn.classify_pins(heads, held)
