"""References from a step's input to another step's output: ``{"$task_output": id, "pointer": p}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn

# In canonical JSON (sorted keys, no spaces) a well-formed reference has exactly this text.  Nothing in a string is tried
# twice, which also keeps long ones off the stack.
_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_REF = rf'\{{"\$task_output":"({_STRING})"(?:,"pointer":"({_STRING})")?\}}'
_HEAD = '{"$task_output":"'
_KEY = '"$task_output":'
# Outputs up to so many characters are walked object by object; in larger ones a path is looked up, which has to be read
# first but touches no more than it names.
WALKED = 4096
# References of a step that are gathered at a time; a window hands what it gathered to each of its rows.
GATHERED = 32


def _times(text: str, part: str) -> Column:
    """How often ``part`` is in the column ``text``."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def _ref_id(ref: Column) -> Column:
    """The id in the text of a reference; only escapes need a JSON reader."""
    plain = F.substring_index(F.substr(ref, F.lit(len(_HEAD) + 1)), '"', 1)
    return F.when(F.contains(ref, F.lit("\\")), F.get_json_object(ref, "$['$task_output']")).otherwise(plain)


def _pointer(ref: Column) -> Column:
    """The pointer in the text of a reference, null if it has none."""
    plain = F.substring_index(F.substring_index(ref, '"', -2), '"', 1)
    escaped = F.contains(ref, F.lit("\\"))
    return F.when(escaped, F.get_json_object(ref, "$.pointer")).when(F.contains(ref, F.lit('","pointer":"')), plain)


def _found_refs(nodes: DataFrame) -> DataFrame:
    """Adds ``v``, ``text``, ``found`` (the texts of the well-formed references, in order) and ``malformed``.

    Each layer is a projection of its own, so that nothing is parsed or searched twice.
    """
    parsed = nodes.withColumn("v", jsonfn.parse("input")).withColumn("text", F.to_json("v"))
    # A key that only ends in the reserved one has an escaped quote before it.
    uses = F.when(F.contains("text", F.lit(_KEY)), _times("text", _KEY) - _times("text", "\\" + _KEY))
    marked = parsed.withColumn("marks", uses)
    found = marked.withColumn(
        "found", F.when(F.col("marks") > 0, F.regexp_extract_all("text", F.lit(_REF), 0)).otherwise(F.array().cast("array<string>"))
    )
    return found.withColumn("malformed", F.coalesce(F.col("marks") > F.size("found"), F.lit(False))).drop("marks")


def with_output_refs(nodes: DataFrame) -> DataFrame:
    """Adds to every step: ``v`` (its parsed input), ``text`` (its canonical JSON), ``refs`` (array of ref_id and
    pointer in text order) and ``malformed`` (the reserved key is used in any other shape).
    """
    refs = F.transform("found", lambda t: F.struct(_ref_id(t).alias("ref_id"), _pointer(t).alias("pointer")))
    return _found_refs(nodes).withColumn("refs", refs).drop("found")


def pointer_path(pointer: Column, numeric_as_index: bool) -> Column:
    """JSON pointer to variant path.  A numeric part may be an array index or an object key; the caller tries both."""
    parts = F.filter(F.split(F.coalesce(pointer, F.lit("")), "/"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(p: Column) -> Column:
        key = F.concat(F.lit("['"), p, F.lit("']"))
        return F.when(p.rlike(r"^\d+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(key) if numeric_as_index else key

    return F.concat(F.lit("$"), F.array_join(F.transform(plain, step), ""))


def _walk(value: Column, parts: Column, numeric_as_index: bool) -> Column:
    """What ``pointer_path`` leads to, part by part."""

    def step(at: Column, part: Column) -> Column:
        of_key = F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), part)
        of_index = F.get(F.try_variant_get(at, "$", "array<variant>"), part.try_cast("int"))
        return F.when(part.rlike(r"^\d+$"), of_index).otherwise(of_key) if numeric_as_index else of_key

    return F.aggregate(parts, value, step)


def _pointed(value: Column, pointer: Column, small: Column) -> Column:
    """The variant that ``pointer`` names in ``value``."""
    parts = F.filter(F.split(pointer, "/"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def either(get) -> Column:
        # Without a numeric part both are the same.
        return F.coalesce(get(True), F.when(F.exists(parts, lambda p: p.rlike(r"^\d+$")), get(False)))

    # What a path cannot say: it has no such keys, drops blanks before them and ends at nine digits.
    odd = pointer.rlike(r"['?\s]|\d{10}")
    walked = either(lambda numeric: _walk(value, plain, numeric))
    looked_up = either(lambda numeric: F.try_variant_get(value, pointer_path(pointer, numeric), "variant"))
    return F.when(small | odd, walked).otherwise(looked_up)


def _firsts(rows: DataFrame, window, values: Column) -> DataFrame:
    """The first row of each partition of ``window``, with the ``values`` and the first ``reason`` of all its rows."""
    every = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = {"values": values.over(every), "reason": F.first("reason", True).over(every), "no": F.row_number().over(window)}
    return rows.withColumns(got).filter(F.col("no") == 1).drop("value", "no")


def resolve_refs(nodes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs with every reference replaced, or the reason one could not be.

    ``nodes``: plan_id, node_id, input.  ``outputs``: plan_id, node_id, output.  The text between references is kept
    and joined with the resolved values, so an inserted value is never searched again.
    """
    read = _found_refs(nodes.select("plan_id", "node_id", "input")).select("plan_id", "node_id", "text", "malformed", "found")
    small = (F.length("output") <= WALKED).alias("small")
    held = outputs.select("plan_id", F.col("node_id").alias("ref_id"), jsonfn.parse("output").alias("v"), small)
    each = read.select("plan_id", "node_id", "text", "malformed", F.posexplode_outer("found").alias("pos", "ref"))
    # The text of a step goes with its first reference only.
    first = F.coalesce("pos", F.lit(0)) == 0
    asked = each.select(
        "plan_id", "node_id", F.when(first, F.col("text")).alias("text"), "malformed", "pos",
        _ref_id(F.col("ref")).alias("ref_id"), F.nullif(_pointer(F.col("ref")), F.lit("")).alias("pointer"),
    )
    # The hash leads, as ids alike in their first characters sort slowly.
    key = F.xxhash64("plan_id", "ref_id")
    joined = asked.withColumn("key", key).join(held.withColumn("key", key), ["key", "plan_id", "ref_id"], "left")
    hit = F.when(F.col("pointer").isNull(), F.col("v")).otherwise(_pointed(F.col("v"), F.col("pointer"), F.col("small")))
    valued = joined.withColumn("hit", hit).withColumn("value", F.to_json("hit"))
    wanted = F.col("ref_id").isNotNull()
    reason = F.when(F.col("malformed"), "malformed_ref").when(wanted & F.col("v").isNull(), "unknown_task").when(
        wanted & F.col("value").isNull(), "pointer_miss"
    )
    step = ["key", "plan_id", "node_id"]
    part = (F.coalesce("pos", F.lit(0)) / GATHERED).cast("int").alias("part")
    solved = valued.select("plan_id", "node_id", part, "pos", "text", "value", reason.alias("reason"))
    # Rows are dealt and sorted once for both windows, whose first rows hold the text.
    dealt = solved.repartition("plan_id", "node_id").withColumn("key", F.xxhash64("plan_id", "node_id"))
    some, whole = Window.partitionBy(*step, "part").orderBy("pos"), Window.partitionBy(*step).orderBy("part")
    in_part = _firsts(dealt, some, F.collect_list("value"))
    per_step = _firsts(in_part.withColumnRenamed("values", "value"), whole, F.collect_list("value"))
    filled = F.array_join(
        F.zip_with(
            F.split("text", _REF),
            F.flatten("values"),
            lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))),
        ),
        "",
    )
    plain = ~F.contains("text", F.lit(_KEY))
    resolved = F.when(F.col("reason").isNull(), F.when(plain, F.col("text")).otherwise(filled))
    return per_step.select("plan_id", "node_id", resolved.alias("resolved_input"), "reason")
