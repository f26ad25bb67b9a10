"""Merging the item lists many nodes return for one request.

``contributions``: request_id, node_id, status (ok|failed|timed_out|skipped), duration_ms, output (JSON text), error;
one row per (request_id, node_id).  Node order is the order of ``node_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import jsonfn
from fleetlens.functions.text import snippet_chars
from fleetlens.operators.ordered import RunningSum, oldest_by, ordered_scan, top_k, unpack

# Bounds of a merged output and of a failure message.
MAX_ERRORS_IN_MESSAGE = 5
ERROR_SNIPPET_CHARS = 160
POLICY_LABELS = {"wait": "federated wait", "fail_fast": "federated fail-fast", "return_partial": "federated"}


def _with_items(contributions: DataFrame) -> DataFrame:
    ok = contributions.filter(F.col("status") == "ok")
    # Parsed in a projection of its own: an expression used several times in one is evaluated several times.
    parsed = ok.select("request_id", "node_id", jsonfn.parse("output").alias("v"))
    return parsed.select("request_id", "node_id", jsonfn.items_of(F.col("v")).alias("items"))


def unwrap_items(contributions: DataFrame) -> DataFrame:
    """One row per item: request_id, node_id, pos (0-based), item (VARIANT).  Only ok contributions have items."""
    return unpack(_with_items(contributions), ["request_id", "node_id"], F.col("items"), "pos", "item")


def merge_concat(contributions: DataFrame, cap: int | None = None, node_prefix: int = 6) -> DataFrame:
    """The items of each request in (node, position) order: the first ``cap`` of them, or all.

    Positions follow from the item counts of earlier nodes, so no items are sorted, and contributions wholly past
    the cap are dropped before they are unpacked.  ``node_prefix`` is the number of leading node-id characters
    that bucket a request with very many nodes.
    """
    sized = _with_items(contributions).withColumn("n", F.size("items").cast("long"))
    counted = ordered_scan(
        sized, ["request_id"], ["node_id"], [RunningSum("through", F.col("n"))], F.substring("node_id", 1, node_prefix)
    )
    before = counted.withColumn("before", F.col("through") - F.col("n"))
    if cap is not None:
        before = before.filter(F.col("before") < cap)
    items = unpack(before, ["request_id", "node_id", "before"], F.col("items"), "pos", "item")
    numbered = items.withColumn("item_no", F.col("before") + F.col("pos") + 1)
    if cap is not None:
        numbered = numbered.filter(F.col("item_no") <= cap)
    return numbered.select("request_id", "item_no", "node_id", "pos", "item")


def merge_accounting(contributions: DataFrame, cap: int | None = None) -> DataFrame:
    """Per request: items contributed, surfaced and truncated by a concat of at most ``cap``."""
    counts = _with_items(contributions).groupBy("request_id").agg(F.sum(F.size("items")).alias("contributed"))
    surfaced = F.col("contributed") if cap is None else F.least("contributed", F.lit(cap).cast("long"))
    return counts.select("request_id", "contributed", surfaced.alias("surfaced"), (F.col("contributed") - surfaced).alias("truncated"))


def merge_dedupe(items: DataFrame, key: str) -> DataFrame:
    """First item per key value in (node, position) order; items without the key are all kept.

    Key identity is the JSON text: ``1`` differs from ``"1"`` and a present null is a value.
    """
    key_text = jsonfn.text_at(F.col("item"), f"$['{key}']")
    keyed = items.select(
        "request_id",
        key_text.alias("key_text"),
        F.when(key_text.isNull(), F.struct("node_id", "pos")).alias("own"),
        "node_id",
        "pos",
        "item",
    )
    first = oldest_by(keyed, ["request_id", "key_text", "own"], F.struct("node_id", "pos"))
    return first.drop("own")


def merge_top_k(items: DataFrame, k: int, score_field: str = "score") -> DataFrame:
    """Best ``k`` items per request; a missing or non-numeric score counts 0, ties keep input order."""
    scored = items.withColumn(
        "score", F.coalesce(jsonfn.number_at(F.col("item"), f"$['{score_field}']"), F.lit(0.0))
    )
    return top_k(scored, ["request_id"], [F.desc("score"), F.asc("node_id"), F.asc("pos")], k)


def merge_rerank(items: DataFrame, k: int, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Top k by ``scorer(item)``; without a scorer, by the items' own ``score``."""
    if scorer is None:
        return merge_top_k(items, k, "score")
    scored = items.withColumn("score", F.coalesce(scorer(F.col("item")), F.lit(0.0)))
    return top_k(scored, ["request_id"], [F.desc("score"), F.asc("node_id"), F.asc("pos")], k)


def merge_aggregate(items: DataFrame, op: str | Sequence[str], field: str) -> DataFrame:
    """sum|min|max|mean|count of a JSON-number field, one row per request and operation, in one pass over the items;
    an extremum or mean over no numbers is an error row."""
    ops = [op] if isinstance(op, str) else list(op)
    folds = {
        "sum": F.coalesce(F.sum("number"), F.lit(0.0)),
        "min": F.min("number"),
        "max": F.max("number"),
        "mean": F.avg("number"),
        "count": F.count("number").cast("double"),
    }
    unknown = [o for o in ops if o not in folds]
    if unknown:
        raise ValueError(f"unknown aggregate {unknown[0]!r}")
    number = jsonfn.number_at(F.col("item"), f"$['{field}']")
    grouped = items.select("request_id", number.alias("number")).groupBy("request_id").agg(
        F.count("number").alias("count"), *[folds[o].alias(f"__{o}") for o in ops]
    )
    one_row = F.array(*[F.struct(F.lit(o).alias("op"), F.col(f"__{o}").alias("raw")) for o in ops])
    unpivoted = grouped.select("request_id", "count", F.inline(one_row))
    finite = F.when(F.isnan("raw") | (F.abs("raw") == float("inf")), 0.0).otherwise(F.col("raw"))
    missing = F.col("raw").isNull()
    return unpivoted.select(
        "request_id",
        "op",
        F.when(~missing, finite).alias("value"),
        "count",
        F.when(missing, F.lit(f"aggregate field {field!r} missing or non-numeric in every item")).alias("reason"),
    )


def settle(contributions: DataFrame, policy: str = "return_partial") -> DataFrame:
    """Which requests may merge.  wait and fail_fast need every node; return_partial needs one."""
    if policy not in POLICY_LABELS:
        raise ValueError(f"unknown policy {policy!r}")
    counts = contributions.groupBy("request_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") == "ok").alias("ok")
    )
    failed = F.col("ok") == 0 if policy == "return_partial" else F.col("ok") < F.col("nodes")
    return counts.withColumn("outcome", F.when(failed, "failed").otherwise("merged"))


def provenance(contributions: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Per node: status, duration and items contributed; nodes left out at planning appear as skipped."""
    parsed = contributions.withColumn("v", F.when(F.col("status") == "ok", jsonfn.parse("output")))
    given = parsed.select(
        "request_id",
        "node_id",
        "status",
        F.col("duration_ms").cast("long").alias("duration_ms"),
        F.coalesce(F.size(jsonfn.items_of(F.col("v"))), F.lit(0)).cast("long").alias("item_count"),
    )
    if excluded is None:
        return given
    left_out = excluded.select(
        "request_id",
        "node_id",
        F.lit("skipped").alias("status"),
        F.lit(0).cast("long").alias("duration_ms"),
        F.lit(0).cast("long").alias("item_count"),
    )
    return given.unionByName(left_out)


def failure_summary(contributions: DataFrame, policy: str = "return_partial") -> DataFrame:
    """One message per failed request: how many nodes were ok and the first five errors in node order."""
    failed = settle(contributions, policy).filter(F.col("outcome") == "failed")
    said = F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.col("status")).otherwise(
        snippet_chars(F.col("error"), ERROR_SNIPPET_CHARS)
    )
    bad = contributions.filter(F.col("status") != "ok").select("request_id", "node_id", said.alias("said"))
    first = top_k(bad, ["request_id"], [F.asc("node_id")], MAX_ERRORS_IN_MESSAGE)
    listed = first.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "node_id", "said"))).alias("errors")
    )
    parts = F.transform("errors", lambda e: F.concat(F.lit("; "), e["node_id"], F.lit(": "), e["said"]))
    more = F.col("nodes") - F.col("ok") - MAX_ERRORS_IN_MESSAGE
    message = F.concat(
        F.lit(f"{POLICY_LABELS[policy]}: "),
        F.col("ok").cast("string"),
        F.lit("/"),
        F.col("nodes").cast("string"),
        F.lit(" nodes ok"),
        F.coalesce(F.array_join(parts, ""), F.lit("")),
        F.when(more > 0, F.concat(F.lit("; …and "), more.cast("string"), F.lit(" more"))).otherwise(""),
    )
    return failed.join(listed, "request_id", "left").select("request_id", "ok", "nodes", message.alias("message"))


def settle_requests(contributions: DataFrame, policies: DataFrame) -> DataFrame:
    """``settle`` where every request has its own policy; requests without one return what they have."""
    counts = contributions.groupBy("request_id").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") == "ok").alias("ok")
    )
    own = counts.join(policies.select("request_id", "policy"), "request_id", "left")
    partial = F.coalesce("policy", F.lit("return_partial")) == "return_partial"
    failed = F.when(partial, F.col("ok") == 0).otherwise(F.col("ok") < F.col("nodes"))
    return own.withColumn("outcome", F.when(failed, "failed").otherwise("merged"))


def merge_requests(contributions: DataFrame, policies: DataFrame) -> DataFrame:
    """Merge every request by its own policy and strategy: request_id, outcome, strategy, item_no, node_id, pos, item.

    ``policies``: request_id, policy (wait|fail_fast|return_partial), strategy (concat|dedupe|top_k), field (the key of
    dedupe, the score of top_k), k.  Requests that do not settle have one row without an item; so have those without
    items.  Items are numbered from 1: in (node, position) order, for top_k from the best.
    """
    settled = settle_requests(contributions, policies).select("request_id", "outcome")
    plan = policies.select("request_id", F.coalesce("strategy", F.lit("concat")).alias("strategy"), "field", "k")
    merged = settled.filter(F.col("outcome") == "merged").join(plan, "request_id", "left").drop("outcome")
    live = contributions.join(merged.select("request_id"), "request_id", "left_semi")
    items = unwrap_items(live).join(merged, "request_id").withColumn("strategy", F.coalesce("strategy", F.lit("concat")))
    value = F.try_variant_get(F.col("item"), F.concat(F.lit("$['"), F.col("field"), F.lit("']")), "variant")

    # The key's JSON text is compared; items without the key are all kept.
    keyed = items.filter(F.col("strategy") == "dedupe").withColumn("key_text", F.to_json(value))
    own = F.when(F.col("key_text").isNull(), F.struct("node_id", "pos"))
    rest = ["request_id", "strategy", "node_id", "pos", "item", "field", "k"]
    first = oldest_by(keyed.withColumn("own", own).select(*rest, "key_text", "own"), ["request_id", "key_text", "own"], F.struct("node_id", "pos"))
    in_order = items.filter(F.col("strategy") == "concat").select(*rest).unionByName(first.select(*rest))
    numbered = ordered_scan(
        in_order.groupBy("request_id", "node_id").agg(F.count("*").alias("n")),
        ["request_id"],
        ["node_id"],
        [RunningSum("through", F.col("n"))],
        F.substring("node_id", 1, 6),
    ).select("request_id", "node_id", (F.col("through") - F.col("n")).alias("before"))
    within = Window.partitionBy("request_id", "node_id").orderBy("pos")
    in_order = in_order.withColumn("at", F.row_number().over(within)).join(numbered, ["request_id", "node_id"])
    in_order = in_order.withColumn("item_no", (F.col("before") + F.col("at")).cast("long"))

    said = items.filter(F.col("strategy") == "top_k").withColumn("said", F.to_json(value))
    # The first character of its JSON text tells a number from a numeric string.
    scored = said.withColumn("score", F.coalesce(F.when(F.col("said").rlike(r"^-?\d"), F.col("said").try_cast("double")), F.lit(0.0)))
    largest = F.coalesce("k", F.lit(1))
    salt = F.pmod(F.xxhash64("node_id", "pos"), F.lit(64))
    best = [F.desc("score"), F.asc("node_id"), F.asc("pos")]
    inner = Window.partitionBy("request_id", salt).orderBy(*best)
    cut = scored.withColumn("at", F.row_number().over(inner)).filter(F.col("at") <= largest)
    ranked = cut.withColumn("item_no", F.row_number().over(Window.partitionBy("request_id").orderBy(*best)).cast("long")).filter(F.col("item_no") <= largest)

    columns = ["request_id", "item_no", "node_id", "pos", "item"]
    found = in_order.select(*columns).unionByName(ranked.select(*columns))
    out = settled.join(plan.select("request_id", "strategy"), "request_id", "left").join(found, "request_id", "left")
    return out.select("request_id", "outcome", F.coalesce("strategy", F.lit("concat")).alias("strategy"), "item_no", "node_id", "pos", "item")
