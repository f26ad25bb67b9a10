"""Accounting of fan-outs and plan runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.plans.checkpoints import PLAN_CAPABILITY, aggregate_is_complete
from fleetlens.vocab import is_terminal


def fanout_summary(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per fan-out: items pulled, how they ended, and why it ended.

    ``outcomes``: run_id, status (ok|failed|timed_out|dropped).  ``runs``: run_id, fail_fast, deadline_hit.
    """
    counts = outcomes.groupBy("run_id").agg(
        F.count("*").alias("pulled"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "timed_out").alias("timed_out"),
        F.count_if(F.col("status") == "dropped").alias("dropped_in_flight"),
    )
    joined = runs.join(counts, "run_id", "left").na.fill(0, ["pulled", "ok", "failed", "timed_out", "dropped_in_flight"])
    reason = (
        F.when(F.col("deadline_hit"), "deadline_exceeded")
        .when(F.col("fail_fast") & (F.col("failed") + F.col("timed_out") > 0), "failed_fast")
        .otherwise("source_drained")
    )
    return joined.select("run_id", "pulled", "ok", "failed", "timed_out", "dropped_in_flight", reason.alias("reason"))


def plan_summary(steps: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan: how its steps ended, and the verdict.

    ``steps``: plan_id, step_id, state (done|failed|timed_out|skipped|waiting|in_flight), replayed.
    ``plans``: plan_id, deadline_hit, aborted, budget_stop (NULL or the status a budget stop gives the plan).
    A deadline or an abort outranks a budget stop, and a budget stop only counts if it left steps unscheduled.
    """
    counts = steps.groupBy("plan_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "done").alias("ok"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "timed_out").alias("timed_out"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if(F.col("replayed")).alias("replayed"),
        F.count_if(F.col("state").isin("waiting", "in_flight")).alias("unscheduled"),
    )
    joined = plans.join(counts, "plan_id")
    stopped = F.col("budget_stop").isNotNull()
    clean = ~F.col("aborted") & ~F.col("deadline_hit") & (F.col("ok") > 0)
    good = (F.col("ok") == F.col("total")) | clean
    status = F.when(stopped & (F.col("unscheduled") > 0), F.col("budget_stop")).otherwise("done")
    error = F.when(F.col("deadline_hit"), "plan deadline exceeded").when(
        F.col("aborted"), "plan aborted (fail_fast)"
    ).otherwise("no step succeeded")
    return joined.select(
        "plan_id",
        "total",
        "ok",
        "failed",
        "timed_out",
        "skipped",
        "replayed",
        "unscheduled",
        F.when(good, status).otherwise("failed").alias("status"),
        F.when(~good, error).alias("error"),
    )


def resume_points(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """What is left of every plan run: steps in flight, whose outcome is unknown, and steps never started.

    ``tasks``: id, plan_id, capability, state.  The steps' own rows count beside what the run's result lists, because
    a run that failed or crashed has no such list.
    """
    runs = tasks.filter(F.col("capability") == PLAN_CAPABILITY).select("id", "plan_id")
    outcome = runs.join(results.select(F.col("task_id").alias("id"), "output"), "id", "left")
    v = F.col("v")
    parsed = outcome.select("plan_id", "output", jsonfn.parse("output").alias("v"))

    def listed(name: str) -> DataFrame:
        ids = F.try_variant_get(v, f"$.resume.{name}", "array<string>")
        return parsed.select("plan_id", F.explode(ids).alias("step_id"), F.lit(name).alias("kind"))

    open_rows = (
        tasks.filter((F.col("capability") != PLAN_CAPABILITY) & ~is_terminal(F.col("state")))
        .join(runs.select("plan_id").distinct(), "plan_id", "left_semi")
        .select("plan_id", F.col("id").alias("step_id"), F.lit("in_flight").alias("kind"))
    )
    complete = parsed.groupBy("plan_id").agg(F.max(aggregate_is_complete(F.col("output"))).alias("complete"))
    left = listed("in_flight").unionByName(listed("unscheduled")).unionByName(open_rows).distinct()
    return complete.join(left, "plan_id", "left")
