"""Hash-chained audit logs.

``audit``: node_id, seq, at_ms, action, subject, detail (JSON text), actor, prev_hash, entry_hash, received_at_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.functions.hashing import entry_hash
from fleetlens.operators.ordered import LastKnown, Previous, newest_by, oldest_by, ordered_scan, seq_bucket
from fleetlens.session import written
from fleetlens.vocab import AUDIT_ACTIONS, NOTABLE_ACTIONS, ZERO_HASH

TRUNCATED = "audit.truncated"
# Entries of a node that are ordered in one piece; longer chains are split.
NODE_ENTRIES = 65_536
CHAIN_ORDER = ["seq", "entry_hash"]


def audit_filter(
    audit: DataFrame,
    action: str | None = None,
    node: str | None = None,
    actor_prefix: str | None = None,
    since_ms: int | None = None,
    until_ms: int | None = None,
) -> DataFrame:
    """``since_ms`` is inclusive, ``until_ms`` exclusive."""
    tests = []
    if action is not None:
        tests.append(F.col("action") == action)
    if node is not None:
        tests.append(F.col("node_id") == node)
    if actor_prefix:
        tests.append(F.startswith("actor", F.lit(actor_prefix)))
    if since_ms is not None:
        tests.append(F.col("at_ms") >= since_ms)
    if until_ms is not None:
        tests.append(F.col("at_ms") < until_ms)
    for test in tests:
        audit = audit.filter(test)
    return audit


def flag_notable(audit: DataFrame) -> DataFrame:
    """Mark work leaving the network, refusals and secret reads."""
    return audit.withColumn("notable", F.col("action").isin(*NOTABLE_ACTIONS))


def suppression_rows(audit: DataFrame) -> DataFrame:
    """Rows that stand for suppressed repeats, with their counts and window start."""
    v = F.col("v")
    parsed = audit.withColumn("v", jsonfn.parse("detail"))
    return parsed.select(
        "node_id",
        "seq",
        "action",
        jsonfn.number_at(v, "$.suppressed_repeats").alias("repeats"),
        F.coalesce(jsonfn.number_at(v, "$.distinct_subjects"), F.lit(0.0)).alias("distinct_subjects"),
        jsonfn.number_at(v, "$.window_start_ms").alias("since_ms"),
    ).filter(F.col("repeats").isNotNull())


def computed_hash(audit: DataFrame) -> Column:
    c = audit
    return entry_hash(
        c["node_id"], c["seq"], c["at_ms"], c["action"], c["subject"], c["detail"], c["actor"], c["prev_hash"]
    )


def entry_hashes(audit: DataFrame) -> DataFrame:
    """Stored and recomputed hash of every entry."""
    return audit.select("node_id", "seq", "entry_hash", computed_hash(audit).alias("computed_hash"))


def chain_entries(audit: DataFrame) -> DataFrame:
    """node_id, seq, prev_hash, entry_hash, sound and claim of every entry, written once to the shared folder.

    The one pass over the whole chain: every hash is computed here and details stay behind.  ``sound``: the action is
    known and the hash is the entry's own.  ``claim``: what a truncation marker says it follows, else NULL.
    """
    sound = F.col("action").isin(*AUDIT_ACTIONS) & (computed_hash(audit) == F.col("entry_hash"))
    detail = jsonfn.parse("detail")
    claim = F.struct(
        jsonfn.number_at(detail, "$.through_seq").cast("long").alias("through_seq"),
        jsonfn.string_at(detail, "$.through_hash").alias("through_hash"),
    )
    return written(
        audit.select(
            "node_id",
            "seq",
            "prev_hash",
            "entry_hash",
            F.coalesce(sound, F.lit(False)).alias("sound"),
            F.when(F.col("action") == TRUNCATED, claim).alias("claim"),
        ),
        "chain",
    )


def chain_bucket(entries: DataFrame) -> Column | None:
    """How ordered scans split the entries: not at all, which takes one shuffle and no join, unless a node has many."""
    largest = entries.groupBy("node_id").count().agg(F.max("count")).first()[0]
    return None if (largest or 0) <= NODE_ENTRIES else seq_bucket("seq")


def _paired(entries: DataFrame) -> DataFrame:
    """Entries with ``linked``: does one follow its predecessor by seq and hash (NULL on a node's first row)?"""
    slim = entries.select("node_id", "seq", "prev_hash", "entry_hash", "sound")
    before = Previous("before", F.struct("seq", "entry_hash"))
    paired = ordered_scan(slim, ["node_id"], CHAIN_ORDER, [before], chain_bucket(entries))
    follows = (F.col("before.seq") + 1 == F.col("seq")) & (F.col("before.entry_hash") == F.col("prev_hash"))
    return paired.withColumn("linked", F.when(F.col("before").isNotNull(), follows)).drop("before")


def _opens() -> Column:
    """The seq at which an entry opens a segment of the chain: after one that is not sound, at one that is not linked."""
    return F.when(~F.col("sound"), F.col("seq") + 1).when(F.coalesce(~F.col("linked"), F.lit(True)), F.col("seq"))


def chain_breaks(entries: DataFrame) -> DataFrame:
    """(node_id, seq, entry_hash, opens) of the entries at which a segment of the chain opens.

    The verified ranges of every node: one row a segment, so as few as the chain has breaks.
    """
    return _paired(entries).select("node_id", "seq", "entry_hash", _opens().alias("opens")).filter("opens IS NOT NULL")


def segment_starts(points: DataFrame, breaks: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """``points`` (node_id, seq, entry_hash of entries, and more) with ``segment_start``: from where the chain is unbroken.

    A range lookup as one ordered scan over the points and the breaks alone; of ``entries`` only the nodes are counted.
    """
    bucket = seq_bucket("seq") if entries is None else chain_bucket(entries)
    rest = F.struct(*[c for c in points.columns if c not in ("node_id", *CHAIN_ORDER)], F.lit(1).alias("__asked"))
    asked = points.select("node_id", *CHAIN_ORDER, F.lit(None).cast("long").alias("opens"), rest.alias("rest"))
    known = breaks.select("node_id", *CHAIN_ORDER, "opens", F.lit(None).cast(asked.schema["rest"].dataType).alias("rest"))
    both = asked.unionByName(known).withColumn("asks", F.col("rest").isNotNull())
    scanned = ordered_scan(
        both, ["node_id"], [*CHAIN_ORDER, "asks"], [LastKnown("segment_start", F.col("opens"))], bucket
    )
    others = [F.col(c) if c in ("node_id", *CHAIN_ORDER) else F.col(f"rest.{c}").alias(c) for c in points.columns]
    return scanned.filter("asks").select(*others, "segment_start")


def check_links(audit: DataFrame) -> DataFrame:
    """Per entry: is it sound by itself, and does it link to its predecessor (NULL on a node's first row)?

    Also ``segment_start``: the seq from which the chain is unbroken up to this entry.
    """
    marked = _paired(chain_entries(audit)).withColumn("opens", _opens())
    return ordered_scan(
        marked, ["node_id"], CHAIN_ORDER, [LastKnown("segment_start", F.col("opens"))], seq_bucket("seq")
    ).drop("opens")


def verify_chain(audit: DataFrame) -> DataFrame:
    """Per node: the first broken entry, or the seq the chain is verified through."""
    broken = ~F.col("sound") | ~F.coalesce("linked", F.lit(True))
    verdict = _paired(chain_entries(audit)).groupBy("node_id").agg(
        F.min("seq").alias("from_seq"),
        F.max("seq").alias("head_seq"),
        F.min(F.when(broken, F.col("seq"))).alias("broken_at_seq"),
        F.count("*").alias("entries"),
    )
    return verdict.withColumn("through_seq", F.when(F.col("broken_at_seq").isNull(), F.col("head_seq")))


def anchor_check(audit: DataFrame, pins: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Why a run of entries may start where it does: genesis, predecessor, marker, pin - or unanchored.

    ``starts`` (node_id, seq) names the first row of each run; by default the lowest seq of every node.
    """
    return anchors_of(chain_entries(audit), pins, starts)


def anchors_of(entries: DataFrame, pins: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``anchor_check`` over entries that ``chain_entries`` wrote."""
    rows = entries.select("node_id", "seq", "prev_hash")
    first = (
        oldest_by(rows, ["node_id"], F.col("seq"))
        if starts is None
        else rows.join(starts.select("node_id", "seq").distinct(), ["node_id", "seq"])
    )
    first = first.withColumn("before_seq", F.col("seq") - 1)
    predecessors = entries.select(
        "node_id", F.col("seq").alias("before_seq"), F.col("entry_hash").alias("stored_hash")
    )
    markers = (
        entries.filter(F.col("claim").isNotNull())
        .select(
            "node_id",
            F.col("claim.through_seq").alias("before_seq"),
            F.col("claim.through_hash").alias("prev_hash"),
            F.lit(True).alias("marked"),
        )
        .distinct()
    )
    pinned = pins.select("node_id", F.col("seq").alias("before_seq"), F.col("entry_hash").alias("pinned_hash"))
    joined = (
        first.join(predecessors, ["node_id", "before_seq"], "left")
        .join(markers, ["node_id", "before_seq", "prev_hash"], "left")
        .join(pinned, ["node_id", "before_seq"], "left")
    )
    by_chain = (
        F.when((F.col("seq") == 1) & (F.col("prev_hash") == ZERO_HASH), "genesis")
        .when(F.col("seq") == 1, "unanchored")
        .when(F.col("stored_hash") == F.col("prev_hash"), "predecessor")
        .when(F.col("stored_hash").isNull() & F.col("marked"), "marker")
        .when(F.col("pinned_hash") == F.col("prev_hash"), "pin")
        .otherwise("unanchored")
    )
    return joined.select("node_id", "seq", by_chain.alias("anchor"))


def prune_with_marker(audit: DataFrame, keep: int, at_ms: int) -> DataFrame:
    """Keep the newest ``keep`` entries of every node and append the marker that accounts for the rest."""
    heads = newest_by(audit.select("node_id", "seq", "entry_hash"), ["node_id"], F.col("seq"))
    heads = heads.select(
        "node_id",
        F.col("seq").alias("head_seq"),
        F.col("entry_hash").alias("head_hash"),
        (F.col("seq") - keep).alias("cut_seq"),
    ).filter(F.col("cut_seq") > 0)
    anchors = audit.select("node_id", F.col("seq").alias("cut_seq"), F.col("entry_hash").alias("cut_hash"))
    cuts = heads.join(anchors, ["node_id", "cut_seq"])

    detail = jsonfn.object_text({"through_seq": F.col("cut_seq"), "through_hash": F.col("cut_hash")})
    marker = cuts.select(
        "node_id",
        (F.col("head_seq") + 1).alias("seq"),
        F.lit(at_ms).cast("long").alias("at_ms"),
        F.lit(TRUNCATED).alias("action"),
        F.lit(None).cast("string").alias("subject"),
        detail.alias("detail"),
        F.lit("system").alias("actor"),
        F.col("head_hash").alias("prev_hash"),
        F.lit(None).cast("long").alias("received_at_ms"),
    )
    marker = marker.withColumn("entry_hash", computed_hash(marker))
    kept = audit.join(cuts.select("node_id", "cut_seq"), "node_id", "left").filter(
        F.col("cut_seq").isNull() | (F.col("seq") > F.col("cut_seq"))
    )
    return kept.drop("cut_seq").unionByName(marker.select(*audit.columns))


def audit_feed(
    audit: DataFrame,
    cursor: tuple[int, str, int] | None = None,
    limit: int = 100,
    action: str | None = None,
    node: str | None = None,
) -> DataFrame:
    """A page of entries, newest first by our own receive time.  ``cursor`` is the last (feed_ms, node_id, seq) seen."""
    rows = audit.withColumn("feed_ms", F.coalesce("received_at_ms", "at_ms"))
    if action is not None:
        rows = rows.filter(F.col("action") == action)
    if node is not None:
        rows = rows.filter(F.col("node_id") == node)
    if cursor is not None:
        ms, last_node, last_seq = cursor
        later_node = (F.col("node_id") < last_node) | ((F.col("node_id") == last_node) & (F.col("seq") < last_seq))
        rows = rows.filter((F.col("feed_ms") < ms) | ((F.col("feed_ms") == ms) & later_node))
    return rows.orderBy(F.desc("feed_ms"), F.desc("node_id"), F.desc("seq")).limit(limit)


def page_verification(page: DataFrame, audit: DataFrame, limit: int) -> DataFrame:
    """Per node on a page: was every row shown covered by a walk of ``limit`` entries up from the lowest one?"""
    spans = page.groupBy("node_id").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("page_max_seq"))
    walk_end = F.col("from_seq") + limit - 1
    bounds = spans.withColumn("walk_end", walk_end)
    rows = check_links(audit).join(bounds, "node_id").filter(F.col("seq").between(F.col("from_seq"), F.col("walk_end")))
    bad = ~F.col("sound") | (~F.coalesce("linked", F.lit(True)) & (F.col("seq") > F.col("from_seq")))
    walked = rows.groupBy("node_id", "from_seq", "page_max_seq").agg(
        F.min(F.when(bad, F.col("seq"))).alias("broken_at_seq"), F.max("seq").alias("reached")
    )
    through = F.when(F.col("broken_at_seq").isNull(), F.col("reached"))
    tone = (
        F.when(F.col("broken_at_seq").isNotNull(), "broken")
        .when(F.col("reached") < F.col("page_max_seq"), "warn")
        .otherwise("ok")
    )
    return walked.select("node_id", "from_seq", "page_max_seq", "broken_at_seq", through.alias("through_seq"), tone.alias("tone"))


def find_forks(audit: DataFrame) -> DataFrame:
    """Every hash at a (node, seq) that differs from the one held first.

    One row per conflicting hash, so a position with n histories yields n-1 rows, not n squared pairs.
    """
    hashes = audit.groupBy("node_id", "seq", "entry_hash").agg(F.min("at_ms").alias("seen_ms"))
    held = hashes.groupBy("node_id", "seq").agg(
        F.min_by("entry_hash", F.struct("seen_ms", "entry_hash")).alias("held_hash"), F.count("*").alias("n")
    )
    forked = held.filter(F.col("n") > 1).drop("n")
    return (
        hashes.join(forked, ["node_id", "seq"])
        .filter(F.col("entry_hash") != F.col("held_hash"))
        .select("node_id", "seq", "held_hash", F.col("entry_hash").alias("other_hash"))
    )
