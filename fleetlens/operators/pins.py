"""Pinned peer heads: positions of other nodes' chains we have seen signed, and what they prove.

``pins``: pin_no (insertion order), node_id, seq, entry_hash, first_seen_ms, observed_at_ms, status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.audit import anchors_of, chain_breaks, chain_entries, computed_hash, segment_starts
from fleetlens.operators.ordered import (
    Previous,
    RunningMax,
    newest_by,
    oldest_by,
    ordered_scan,
    seq_bucket,
    top_k,
)
from fleetlens.vocab import AUDIT_ACTIONS

# Limits of one ingest batch and of a relay.
MAX_DETAIL_BYTES = 4096
MAX_SUBJECT_BYTES = 1024 * 1024
MAX_SKEW_MS = 24 * 60 * 60 * 1000
MAX_BATCH_ROWS = 5_000
RELAY_HEADS = 16


def thin_pins(pins: DataFrame, keep_recent: int, ladder_ms: int) -> DataFrame:
    """Pins that survive thinning.  Only ``unchecked`` pins may go; of those the newest ``keep_recent`` per node,
    the first of every time bucket and the first of every node stay."""
    open_pins = pins.filter(F.col("status") == "unchecked").select("pin_no", "node_id", "first_seen_ms")
    recent = top_k(open_pins, ["node_id"], [F.desc("first_seen_ms"), F.desc("pin_no")], keep_recent).select("pin_no")
    bucket = F.floor(F.col("first_seen_ms") / F.lit(max(ladder_ms, 1)))
    rungs = pins.groupBy("node_id", bucket.alias("rung")).agg(F.min("pin_no").alias("pin_no"))
    oldest = rungs.groupBy("node_id").agg(F.min("pin_no").alias("pin_no"))
    keep = recent.union(rungs.select("pin_no")).union(oldest.select("pin_no")).distinct().withColumn("kept", F.lit(True))
    judged = pins.join(keep, "pin_no", "left")
    return judged.filter((F.col("status") != "unchecked") | F.col("kept")).drop("kept")


def next_pin(pins: DataFrame) -> DataFrame:
    """The pin to verify next per node: first seen last, then the lower claim - never a field its subject controls."""
    return newest_by(pins, ["node_id"], F.struct(F.col("first_seen_ms"), -F.col("seq")))


def relay_heads(pins: DataFrame, n: int = RELAY_HEADS) -> DataFrame:
    """The newest pin of the ``n`` nodes we observed last, ranked by our own observation time."""
    newest = newest_by(pins, ["node_id"], F.struct("first_seen_ms", "seq"))
    return newest.orderBy(F.desc("observed_at_ms"), F.asc("node_id")).limit(n)


def classify_pins(heads: DataFrame, held: DataFrame) -> DataFrame:
    """What each offered head becomes: pinned, stale_pinned, refreshed, fork or rejected_seq.

    ``heads``: head_no (arrival order), node_id, seq, entry_hash.  A head is judged against the pins held and
    against the heads of the batch before it.
    """
    valid = heads.filter(F.col("seq") > 0)
    firsts = oldest_by(valid.select("head_no", "node_id", "seq", "entry_hash"), ["node_id", "seq"], F.col("head_no"))
    firsts = firsts.select(
        "node_id", "seq", F.col("entry_hash").alias("first_hash"), F.col("head_no").alias("first_no")
    )
    stored = held.select("node_id", "seq", F.col("entry_hash").alias("held_hash"))
    highest = held.groupBy("node_id").agg(F.max("seq").alias("held_max"))
    ranked = ordered_scan(
        valid.select("head_no", "node_id", "seq", "entry_hash"),
        ["node_id"],
        ["head_no"],
        [RunningMax("batch_max", F.col("seq"))],
        seq_bucket("head_no"),
    )
    joined = (
        ranked.join(stored, ["node_id", "seq"], "left")
        .join(firsts, ["node_id", "seq"])
        .join(highest, "node_id", "left")
    )
    known = F.coalesce(F.col("held_hash"), F.when(F.col("head_no") > F.col("first_no"), F.col("first_hash")))
    outcome = (
        F.when(known == F.col("entry_hash"), "refreshed")
        .when(known.isNotNull(), "fork")
        .when(F.col("seq") < F.greatest("held_max", "batch_max"), "stale_pinned")
        .otherwise("pinned")
    )
    judged = joined.select("head_no", "node_id", "seq", outcome.alias("outcome"))
    rejected = heads.filter(~F.coalesce(F.col("seq") > 0, F.lit(False))).select(
        "head_no", "node_id", "seq", F.lit("rejected_seq").alias("outcome")
    )
    return judged.unionByName(rejected)


def validate_ingest(
    rows: DataFrame, targets: DataFrame, local_node: str, now_ms: int, max_rows: int = MAX_BATCH_ROWS
) -> DataFrame:
    """The reason each offered row is refused (NULL when it is fine), in fixed precedence.

    ``rows``: batch_id plus the audit columns.  ``targets``: batch_id, target_seq.  A batch over ``max_rows`` is
    refused as a whole before any ordering, which bounds every ordered group by that limit.
    """
    sizes = rows.groupBy("batch_id").agg(F.count("*").alias("n"))
    judged = rows.join(sizes, "batch_id").join(targets.select("batch_id", "target_seq"), "batch_id", "left")
    whole = F.when(F.col("node_id") == local_node, "own_chain").when(F.col("n") > max_rows, "too_many")
    judged = judged.withColumns({"whole": whole, "computed": computed_hash(judged)})
    refused = judged.filter(F.col("whole").isNotNull()).select("batch_id", "node_id", "seq", F.col("whole").alias("reason"))
    inside = ordered_scan(
        judged.filter(F.col("whole").isNull()),
        ["batch_id"],
        ["seq", "entry_hash"],
        [Previous("before", F.struct("seq", "entry_hash"))],
    )
    before = F.col("before")
    reason = (
        F.when(before.isNotNull() & (before["seq"] + 1 != F.col("seq")), "gap")
        .when(F.col("at_ms") > now_ms + MAX_SKEW_MS, "skew")
        .when(F.octet_length("detail") > MAX_DETAIL_BYTES, "detail_too_large")
        .when(F.octet_length("subject") > MAX_SUBJECT_BYTES, "subject_too_large")
        .when(F.col("seq") > F.col("target_seq"), "past_target")
        .when(~F.coalesce(F.col("action").isin(*AUDIT_ACTIONS), F.lit(False)), "unknown_action")
        .when(~F.col("computed").eqNullSafe(F.col("entry_hash")), "hash_mismatch")
        .when(before.isNotNull() & (before["entry_hash"] != F.col("prev_hash")), "broken_link")
    )
    return inside.select("batch_id", "node_id", "seq", reason.alias("reason")).unionByName(refused)


def run_anchor(batches: DataFrame, runs: DataFrame, audit: DataFrame, pins: DataFrame) -> DataFrame:
    """May a batch join its run?  A continuing one must link by seq and hash, a fresh one above seq 1 needs an anchor.

    ``batches``: batch_id, node_id, target_seq and the first row's seq and prev_hash.
    """
    progress = runs.select("node_id", "target_seq", "through_seq")
    stored = audit.select("node_id", F.col("seq").alias("link_seq"), F.col("entry_hash").alias("stored_hash"))
    pinned = pins.select("node_id", F.col("seq").alias("link_seq"), F.col("entry_hash").alias("pinned_hash"))
    joined = (
        batches.join(progress, ["node_id", "target_seq"], "left")
        .withColumn("link_seq", F.coalesce("through_seq", F.col("seq") - 1))
        .join(stored, ["node_id", "link_seq"], "left")
        .join(pinned, ["node_id", "link_seq"], "left")
    )
    continuing = F.col("through_seq").isNotNull()
    links = F.coalesce(F.col("stored_hash") == F.col("prev_hash"), F.lit(False))
    is_pinned = F.coalesce(F.col("pinned_hash") == F.col("prev_hash"), F.lit(False))
    verdict = (
        F.when(continuing & (F.col("seq") != F.col("through_seq") + 1), "not_contiguous")
        .when(continuing & ~links, "broken_run_link")
        .when(~continuing & (F.col("seq") > 1) & ~links & ~is_pinned, "unanchored_start")
        .otherwise("ok")
    )
    return joined.select("batch_id", "node_id", "seq", verdict.alias("verdict"))


def corroborate(pins: DataFrame, audit: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of every pin after its run: corroborated only if the run is complete, the stored hash equals the pin
    and the chain from the run's anchored start to the pin is unbroken; contradicted never changes.

    The whole range is judged by where the unbroken segment around the target starts, so no range join is needed.  The
    chain is read once; what follows reads the narrow table of its entries and the few rows at which segments open.
    """
    entries = chain_entries(audit)
    held = entries.select("node_id", "seq", "entry_hash", F.col("sound").alias("end_sound"))
    pinned = held.join(pins.select("node_id", "seq").distinct(), ["node_id", "seq"])
    ends = segment_starts(pinned, chain_breaks(entries), entries).withColumnRenamed("entry_hash", "stored_hash")
    walked = runs.select(
        "node_id", F.col("target_seq").alias("seq"), F.greatest("from_seq", F.lit(1)).alias("from_seq"), "through_seq", "complete"
    )
    starts = walked.select("node_id", F.col("from_seq").alias("seq"))
    anchors = anchors_of(entries, pins, starts).select("node_id", F.col("seq").alias("from_seq"), "anchor")
    joined = (
        pins.join(walked, ["node_id", "seq"], "left")
        .join(ends, ["node_id", "seq"], "left")
        .join(anchors, ["node_id", "from_seq"], "left")
    )
    proven = (
        F.col("complete")
        & (F.col("through_seq") == F.col("seq"))
        & (F.col("stored_hash") == F.col("entry_hash"))
        & F.col("end_sound")
        & (F.col("segment_start") <= F.col("from_seq"))
        & (F.col("anchor") != "unanchored")
    )
    status = (
        F.when(F.col("status") == "contradicted", "contradicted")
        .when(F.coalesce(proven, F.lit(False)), "corroborated")
        .otherwise("unchecked")
    )
    return joined.select("node_id", "seq", status.alias("status"))
