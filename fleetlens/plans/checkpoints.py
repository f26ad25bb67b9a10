"""Step checkpoints: reuse, completeness and sweeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.functions.hashing import step_hash
from fleetlens.vocab import is_terminal

PLAN_CAPABILITY = "plan.execute"


def step_hashes(nodes: DataFrame) -> DataFrame:
    """Hash of each step's capability and input; the order of keys in the input does not matter."""
    canonical = F.to_json(jsonfn.parse("input"))
    return nodes.select("plan_id", "node_id", step_hash(F.col("capability"), canonical).alias("input_hash"))


def checkpoint_hits(nodes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Which steps may reuse a stored output: same plan and step, same input hash, and an output that still parses.

    ``nodes``: plan_id, node_id, input_hash.
    """
    held = checkpoints.select("plan_id", "node_id", F.col("input_hash").alias("stored_hash"), "output", "task_id")
    joined = nodes.join(held, ["plan_id", "node_id"], "left")
    status = (
        F.when(F.col("stored_hash").isNull(), "miss")
        .when(F.col("stored_hash") != F.col("input_hash"), "changed")
        .when(jsonfn.parse("output").isNull(), "corrupt")
        .otherwise("hit")
    )
    return joined.select(
        "plan_id",
        "node_id",
        status.alias("status"),
        F.when(status == "hit", F.col("task_id")).alias("task_id"),
        F.when(status == "hit", F.col("output")).alias("output"),
    )


def aggregate_is_complete(output: Column) -> Column:
    """A plan aggregate with nothing left to do; an aggregate that cannot be read counts as incomplete."""
    v = F.try_parse_json(output)

    def zero(name: str) -> Column:
        return jsonfn.number_at(v, f"$.{name}") == 0

    complete = (
        (jsonfn.string_at(v, "$.status") == "done")
        & (jsonfn.number_at(v, "$.ok") >= 0)
        & zero("failed")
        & zero("timed_out")
        & zero("skipped")
    )
    return F.coalesce(complete, F.lit(False))


def completed_plans(checkpoints: DataFrame, tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Plans with checkpoints, a complete done run and no run of the same plan still alive."""
    runs = tasks.filter(F.col("capability") == PLAN_CAPABILITY).select("id", "plan_id", "state")
    alive = runs.filter(~is_terminal(F.col("state"))).select("plan_id")
    done = runs.filter(F.col("state") == "done").select(F.col("id").alias("task_id"), "plan_id")
    finished = results.filter(aggregate_is_complete(F.col("output"))).select("task_id")
    return (
        checkpoints.select("plan_id")
        .distinct()
        .join(done.join(finished, "task_id", "left_semi").select("plan_id"), "plan_id", "left_semi")
        .join(alive, "plan_id", "left_anti")
    )


def sweep_checkpoints(checkpoints: DataFrame, completed: DataFrame, cutoff: Column) -> DataFrame:
    """Checkpoints to drop: of completed plans, and any created before ``cutoff``."""
    flagged = checkpoints.join(completed.select("plan_id").distinct().withColumn("over", F.lit(True)), "plan_id", "left")
    old = F.col("created_at") < cutoff
    why = F.when(F.col("over"), "completed").when(old, "old")
    return flagged.select("plan_id", "node_id", why.alias("why")).filter(F.col("why").isNotNull())
