"""The cost ledger: what was spent, by whom, against which limits."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.functions.numeric import exact_sum, is_finite
from fleetlens.functions.timefn import utc_day
from fleetlens.operators.ordered import newest_by, time_bucket, unpack
from fleetlens.session import written
from fleetlens.vocab import is_terminal

PLAN_CAPABILITY = "plan.execute"
# Steps of a plan that are added up in one piece; larger plans are split.
PLAN_STEPS = 65_536


def cost_rows(tasks: DataFrame, results: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """Costed results since ``since`` with their task.  Free rows go before any cap, so they never use it up."""
    paid = results.filter((F.col("cost_usd") > 0) & (F.col("completed_at") >= since))
    joined = paid.select("task_id", "completed_at", "cost_usd").join(
        tasks.select(F.col("id").alias("task_id"), "capability", "plan_id", "issued_by"), "task_id"
    )
    return joined if limit is None else joined.orderBy(F.desc("completed_at"), F.desc("task_id")).limit(limit)


def recent_outputs(tasks: DataFrame, results: DataFrame, capability: str, since: Column, n: int) -> DataFrame:
    """The newest ``n`` outputs of one capability."""
    wanted = tasks.filter(F.col("capability") == capability).select(F.col("id").alias("task_id"))
    recent = results.filter((F.col("completed_at") >= since) & F.col("output").isNotNull())
    return (
        recent.join(wanted, "task_id")
        .select("task_id", "completed_at", "output")
        .orderBy(F.desc("completed_at"), F.desc("task_id"))
        .limit(n)
    )


def active_plans(tasks: DataFrame, plan_ledger: DataFrame) -> DataFrame:
    """Plan runs that are not over, with their spend if any; a plan that has spent nothing is listed too."""
    running = tasks.filter((F.col("capability") == PLAN_CAPABILITY) & ~is_terminal(F.lower("state")))
    ledger = plan_ledger.select("plan_id", "name", "actual_usd")
    return running.select(F.col("id").alias("task_id"), "plan_id").join(ledger, "plan_id", "left")


def price_usage(usage: DataFrame, rates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add ``price_usd``: longest matching model prefix wins, an override beats a built-in rate of equal length.

    Each *distinct* model is expanded into its own prefixes and matched by equality, so neither table is
    broadcast by hand and the match count does not depend on the number of rates.
    """
    table = rates.select("prefix", "usd_in", "usd_out", F.lit(0).alias("is_override"))
    if overrides is not None:
        table = table.unionByName(overrides.select("prefix", "usd_in", "usd_out", F.lit(1).alias("is_override")))
    models = usage.select("model").filter(F.col("model").isNotNull()).distinct()
    each = F.transform(F.sequence(F.lit(0), F.char_length("model")), lambda n: F.col("model").substr(F.lit(1), n))
    prefixes = unpack(models, ["model"], each, "prefix")
    matched = prefixes.join(table, "prefix")
    best = matched.groupBy("model").agg(
        F.max_by(F.struct("usd_in", "usd_out"), F.struct(F.char_length("prefix"), F.col("is_override"))).alias("rate")
    )
    priced = usage.join(best, "model", "left")
    price = (F.col("prompt_tokens") * F.col("rate.usd_in") + F.col("completion_tokens") * F.col("rate.usd_out")) / 1e6
    return priced.withColumn("price_usd", price).drop("rate")


def gate_cost(results: DataFrame, manifests: DataFrame) -> DataFrame:
    """Keep a claimed cost only from a paid-cloud capability and only when it is a finite, non-negative number.

    A capability that several nodes announce with different hints counts as paid if any of them says so.
    """
    paid = F.max(F.coalesce(F.col("cost_hint") == "cloud_paid", F.lit(False)))
    hints = manifests.groupBy("capability").agg(paid.alias("__paid"))
    claimed = F.col("cost_usd")
    keep = F.col("__paid") & is_finite(claimed) & (claimed >= 0)
    return results.join(hints, "capability", "left").withColumn("cost_usd", F.when(keep, claimed)).drop("__paid")


def cost_totals(rows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Spend in the window in one pass: kind (total|day|issuer|plan), key, usd, and today's share on the total row."""
    recent = rows.filter((F.col("cost_usd") > 0) & (F.col("completed_at") >= now - F.expr(f"INTERVAL {days} DAYS")))
    keyed = recent.select(
        utc_day(F.col("completed_at")).alias("day"),
        F.col("issued_by").cast("string").alias("issuer"),
        F.col("plan_id").cast("string").alias("plan"),
        "cost_usd",
    )
    sets = keyed.groupingSets([["day"], ["issuer"], ["plan"], []], "day", "issuer", "plan")
    totals = sets.agg(
        F.grouping_id("day", "issuer", "plan").alias("gid"),
        exact_sum(F.col("cost_usd")).alias("usd"),
        exact_sum(F.when(F.col("day") == utc_day(now), F.col("cost_usd")).otherwise(0.0)).alias("today"),
    )
    kind = (
        F.when(F.col("gid") == 3, "day").when(F.col("gid") == 5, "issuer").when(F.col("gid") == 6, "plan").otherwise("total")
    )
    out = totals.select(
        kind.alias("kind"),
        F.coalesce("day", "issuer", "plan", F.lit("")).alias("key"),
        "usd",
        F.when(F.col("gid") == 7, F.col("today")).alias("today_usd"),
        F.col("gid"),
        "plan",
    )
    return out.filter(~((F.col("gid") == 6) & F.col("plan").isNull())).drop("gid", "plan")


def plan_costs(rows: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Actual spend per plan beside what its newest aggregate reports; either side may be missing."""
    spent = rows.filter((F.col("cost_usd") > 0) & F.col("plan_id").isNotNull())
    actual = spent.groupBy("plan_id").agg(exact_sum(F.col("cost_usd")).alias("spent"))
    parsed = aggregates.withColumn("v", jsonfn.parse("output"))
    v = F.col("v")
    reported = parsed.select(
        jsonfn.string_at(v, "$.plan_id").alias("plan_id"),
        "completed_at",
        "task_id",
        jsonfn.string_at(v, "$.name").alias("name"),
        jsonfn.string_at(v, "$.status").alias("status"),
        jsonfn.number_at(v, "$.budget.spent_usd").alias("reported_spent_usd"),
        jsonfn.number_at(v, "$.budget.cap_usd").alias("cap_usd"),
        jsonfn.number_at(v, "$.budget.soft_limit_usd").alias("soft_limit_usd"),
        jsonfn.boolean_at(v, "$.budget.triggered").alias("triggered"),
    ).filter(F.col("plan_id").isNotNull())
    newest = newest_by(reported, ["plan_id"], F.struct("completed_at", "task_id")).drop("completed_at", "task_id")
    return newest.join(actual, "plan_id", "full").select(
        "plan_id",
        "name",
        F.coalesce("spent", F.lit(0.0)).alias("actual_usd"),
        "reported_spent_usd",
        "cap_usd",
        "soft_limit_usd",
        "triggered",
        "status",
    )


def _clean_limit(limit: Column) -> Column:
    """A limit that makes no sense is read as zero, the strictest reading."""
    return F.when(limit.isNotNull(), F.when(is_finite(limit), F.greatest(limit, F.lit(0.0))).otherwise(0.0))


def effective_budget(plans: DataFrame, default_cap: float | None = 5.0, ceiling: float | None = None) -> DataFrame:
    """Limits in force per plan.  ``has_budget`` with a NULL ``max_cost_usd`` waives the default, never the ceiling."""
    own = F.coalesce(F.col("has_budget"), F.lit(False))
    cap = F.when(own, F.col("max_cost_usd")).otherwise(F.lit(default_cap).cast("double"))
    if ceiling is not None:
        # NULL is skipped and NaN ranks above every number, so the ceiling caps a waiver and a nonsense cap alike.
        cap = F.least(cap, F.lit(float(ceiling)))
    soft = F.when(own, F.col("soft_limit_usd"))
    return plans.select(
        "plan_id",
        _clean_limit(cap).alias("cap_usd"),
        _clean_limit(soft).alias("soft_usd"),
        F.when(own, F.col("on_exceed")).otherwise("cancel").alias("action"),
    )


def budget_verdicts(steps: DataFrame, budgets: DataFrame, bucket: Column | None = None, distinct: bool = False) -> DataFrame:
    """The steps at which a plan first passes its soft limit or its cap; passing the cap silences the soft limit.

    ``steps``: plan_id, step_id, settled_at, cost_usd.  ``budgets``: plan_id, cap_usd, soft_usd.  ``distinct``: equal
    steps count once.

    Steps are shuffled once, by plan; only plans of more than ``PLAN_STEPS`` rows are split by ``bucket`` as well.  Costs
    are not negative, so a limit is passed inside one bucket, which the sums of the buckets tell: budgets meet these sums,
    and only the buckets that pass a limit meet their steps.
    """
    raw = F.col("cost_usd")
    cost = F.when(is_finite(raw) & (raw >= 0), raw).otherwise(0.0).cast("decimal(18,6)")
    large = written(steps.groupBy("plan_id").count().filter(F.col("count") > PLAN_STEPS).select("plan_id"), "large")
    own, dated = ["plan_id"], steps.filter("plan_id IS NOT NULL")
    if not large.isEmpty():
        own = ["plan_id", "__bucket"]
        # A step without a time has no bucket, and comes first.
        day = F.coalesce(time_bucket("settled_at", 86_400) if bucket is None else bucket, F.lit(-(1 << 63))).cast("long")
        marked = dated.withColumn("__day", day).join(large.withColumn("__large", F.lit(True)), "plan_id", "left")
        dated = marked.withColumn("__bucket", F.when(F.col("__large"), F.col("__day")).otherwise(0))
    dealt = dated.select(*own, "step_id", "settled_at", "cost_usd" if distinct else cost.alias("cost")).repartition(*own)
    if distinct:
        dealt = dealt.distinct().withColumn("cost", cost).drop("cost_usd")

    order = W.partitionBy(*own).orderBy("settled_at", "step_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = dealt.withColumn("within", F.sum("cost").over(order))
    sums = dealt.groupBy(*own).agg(F.sum("cost").alias("total"))
    across = W.partitionBy("plan_id").orderBy(own[-1]).rowsBetween(W.unboundedPreceding, -1)
    carry = F.coalesce(F.sum("total").over(across), F.lit(0)) if len(own) > 1 else F.lit(0).cast("decimal(28,6)")
    carried = sums.withColumn("carry", carry).join(budgets, "plan_id")
    first, last = F.col("carry").cast("double"), (F.col("carry") + F.col("total")).cast("double")
    passes = lambda limit: (last > F.col(limit)) & (first <= F.col(limit))
    passed = carried.filter(passes("cap_usd") | passes("soft_usd")).select(*own, "carry", "cap_usd", "soft_usd")

    spent = F.col("carry") + F.col("within")
    joined = running.join(passed, own).withColumns({"spent": spent.cast("double"), "before": (spent - F.col("cost")).cast("double")})
    over_cap = F.coalesce(F.col("spent") > F.col("cap_usd"), F.lit(False))
    exceeded = over_cap & (F.col("before") <= F.col("cap_usd"))
    soft = ~over_cap & (F.col("spent") > F.col("soft_usd")) & (F.col("before") <= F.col("soft_usd"))
    verdict = F.when(exceeded, "exceeded").when(soft, "soft_crossed")
    return (
        joined.withColumn("verdict", verdict)
        .filter(F.col("verdict").isNotNull())
        .select(
            "plan_id",
            "step_id",
            "verdict",
            "spent",
            F.when(F.col("verdict") == "exceeded", F.col("cap_usd")).otherwise(F.col("soft_usd")).alias("limit_usd"),
        )
    )


def fill_days(per_day: DataFrame, today: date, window: int = 30) -> DataFrame:
    """One row per UTC day of the window ending ``today``; days without spend are zero."""
    first = today - timedelta(days=window - 1)
    spine = per_day.sparkSession.range(window).select(
        F.date_format(F.date_add(F.lit(first), F.col("id").cast("int")), "yyyy-MM-dd").alias("day")
    )
    return spine.join(per_day.select("day", "usd"), "day", "left").select("day", F.coalesce("usd", F.lit(0.0)).alias("usd"))


def run_rate(per_day: DataFrame, today: date, window: int = 30) -> DataFrame:
    """Projected 30-day spend; NULL until three days have elapsed since the first spend in the window."""
    start = (today - timedelta(days=window - 1)).isoformat()
    spent = per_day.filter((F.col("usd") > 0) & (F.col("day") >= start))
    folded = spent.agg(exact_sum(F.col("usd")).alias("total_usd"), F.min("day").alias("since"))
    elapsed = F.datediff(F.lit(today), F.to_date("since")) + 1
    return folded.select(
        "total_usd",
        elapsed.cast("long").alias("elapsed_days"),
        F.when(elapsed >= 3, F.col("total_usd") / elapsed * 30).alias("run_rate_usd"),
    )
