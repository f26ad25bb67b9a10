"""Queries: the cost ledger and budgets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fleetlens.catalog import bindings as b
from fleetlens.catalog.bindings import ctes
from fleetlens.catalog.registry import query
from fleetlens.operators import costs
from fleetlens.sources.tables import read_sample

TODAY = date(2000, 6, 30)
NOW = "TIMESTAMP '2000-06-30 12:00:00'"


def _now():
    return F.lit("2000-06-30 12:00:00").cast("timestamp")


def _since(day: str):
    return F.lit(day).cast("timestamp")


COSTED = ctes("tasks", "results", "cost_rows")


@query("cost_rows_c1", f"{COSTED} SELECT * FROM cost_rows WHERE completed_at >= TIMESTAMP '1996-01-01'")
def cost_rows_c1(spark, d):
    return costs.cost_rows(b.tasks(spark, d), b.results(spark, d), _since("1996-01-01")).withColumn(
        "completed_at", F.col("completed_at").cast("timestamp_ntz")
    )


@query(
    "recent_outputs_c2",
    f"""{ctes("tasks", "aggregates")} SELECT a.task_id, strftime(a.completed_at, '%Y-%m-%d') AS day, a.output FROM aggregates a JOIN tasks t ON t.id = a.task_id
    WHERE t.capability = 'plan.execute' AND a.completed_at >= TIMESTAMP '1998-01-01' ORDER BY a.completed_at DESC, a.task_id DESC LIMIT 200""",
)
def recent_outputs_c2(spark, d):
    out = costs.recent_outputs(b.tasks(spark, d), b.aggregates(spark, d), "plan.execute", _since("1998-01-01"), 200)
    return out.select("task_id", F.date_format("completed_at", "yyyy-MM-dd").alias("day"), "output")


_PLAN_COSTS = """newest AS (SELECT * FROM (SELECT *, output->>'$.plan_id' AS plan_id,
   row_number() OVER (PARTITION BY output->>'$.plan_id' ORDER BY completed_at DESC, task_id DESC) AS r FROM aggregates) WHERE r = 1),
 actual AS (SELECT plan_id, sum(cost_usd::DECIMAL(28,6))::DOUBLE AS spent FROM cost_rows GROUP BY plan_id),
 plan_costs AS (SELECT coalesce(n.plan_id, a.plan_id) AS plan_id, output->>'$.name' AS name, coalesce(spent, 0) AS actual_usd,
   (output->>'$.budget.spent_usd')::DOUBLE AS reported_spent_usd, (output->>'$.budget.cap_usd')::DOUBLE AS cap_usd,
   (output->>'$.budget.soft_limit_usd')::DOUBLE AS soft_limit_usd, (output->>'$.budget.triggered')::BOOLEAN AS triggered,
   output->>'$.status' AS status FROM newest n FULL JOIN actual a ON a.plan_id = n.plan_id)"""
PLAN_COSTS = ctes("tasks", "results", "cost_rows", "aggregates") + ", " + _PLAN_COSTS


def _rows(spark, d):
    return costs.cost_rows(b.tasks(spark, d), b.results(spark, d), _since("1990-01-01"))


@query("plan_costs_d10", f"{PLAN_COSTS} SELECT * FROM plan_costs")
def plan_costs_d10(spark, d):
    return costs.plan_costs(_rows(spark, d), b.aggregates(spark, d))


@query(
    "active_plans_c3",
    f"""{PLAN_COSTS} SELECT t.id AS task_id, t.plan_id, p.name, p.actual_usd FROM tasks t LEFT JOIN plan_costs p USING (plan_id)
    WHERE t.capability = 'plan.execute' AND t.state NOT IN ('done', 'failed', 'cancelled', 'expired')""",
)
def active_plans_c3(spark, d):
    return costs.active_plans(b.tasks(spark, d), costs.plan_costs(_rows(spark, d), b.aggregates(spark, d)))


RATES = [("econ", 10.0, 50.0), ("economy-brand#1", 5.0, 25.0), ("promo", 3.0, 15.0), ("sta", 0.1, 0.4), ("small-brand#2", 2.5, 10.0), ("medium", 0.15, 0.6)]
OVERRIDES = [("promo", 1.0, 5.0), ("small-brand#25", 2.0, 8.0)]
_VALUES = ", ".join(f"('{p}', {i}, {o}, 0)" for p, i, o in RATES) + ", " + ", ".join(f"('{p}', {i}, {o}, 1)" for p, i, o in OVERRIDES)


@query(
    "price_usage_c8",
    f"""WITH r(prefix, usd_in, usd_out, over) AS (VALUES {_VALUES}),
    m AS (SELECT DISTINCT lower(p_type || '-' || p_brand) AS model FROM part),
    best AS (SELECT * FROM (SELECT m.model, r.*, row_number() OVER (PARTITION BY m.model ORDER BY length(prefix) DESC, over DESC) AS n
             FROM m JOIN r ON starts_with(m.model, r.prefix)) WHERE n = 1)
    SELECT l_orderkey AS task_id, u.model, prompt_tokens, completion_tokens,
           (prompt_tokens * usd_in + completion_tokens * usd_out) / 1e6 AS price_usd
    FROM (SELECT l_orderkey, lower(p_type || '-' || p_brand) AS model, l_quantity::BIGINT * 100 AS prompt_tokens, l_partkey AS completion_tokens
          FROM lineitem JOIN part ON p_partkey = l_partkey) u LEFT JOIN best ON best.model = u.model""",
)
def price_usage_c8(spark, d):
    li = read_sample(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    part = read_sample(spark, d, "part").select("p_partkey", F.lower(F.concat_ws("-", "p_type", "p_brand")).alias("model"))
    usage = li.join(part, "p_partkey").select(
        F.col("l_orderkey").alias("task_id"),
        "model",
        (F.col("l_quantity").cast("long") * 100).alias("prompt_tokens"),
        F.col("p_partkey").alias("completion_tokens"),
    )
    schema = "prefix string, usd_in double, usd_out double"
    return costs.price_usage(usage, spark.createDataFrame(RATES, schema), spark.createDataFrame(OVERRIDES, schema)).select(
        "task_id", "model", "prompt_tokens", "completion_tokens", "price_usd"
    )


@query(
    "gate_cost_b10",
    """SELECT l_orderkey AS task_id, p_brand AS capability, CASE WHEN p_size % 3 = 0 AND l_tax <> 0.08 AND l_discount <> 0 THEN l_extendedprice END AS cost_usd
    FROM lineitem JOIN part ON p_partkey = l_partkey""".replace("p_size % 3 = 0", "replace(p_brand, 'Brand#', '')::INT % 3 = 0"),
)
def gate_cost_b10(spark, d):
    li = read_sample(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_extendedprice", "l_discount", "l_tax"
    )
    part = read_sample(spark, d, "part").select("p_partkey", F.col("p_brand").alias("capability"))
    claimed = (
        F.when(F.col("l_tax") == 0.08, float("nan")).when(F.col("l_discount") == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    )
    results = li.join(part, "p_partkey").select(F.col("l_orderkey").alias("task_id"), "capability", claimed.alias("cost_usd"))
    paid = F.regexp_replace("capability", "Brand#", "").try_cast("int") % 3 == 0
    hints = part.select("capability", F.when(paid, "cloud_paid").otherwise("free").alias("cost_hint"))
    return costs.gate_cost(results, hints).select("task_id", "capability", "cost_usd")


_TOTALS = f"""win AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, 'c' || o_custkey AS issuer, CASE WHEN o_orderstatus <> 'P' THEN 's' || o_orderstatus END AS plan, o_totalprice::DECIMAL(28,6) AS usd
 FROM orders WHERE o_totalprice > 0 AND o_orderdate >= {NOW} - INTERVAL 3650 DAY)"""


@query(
    "cost_totals_d9",
    f"""WITH {_TOTALS}
    SELECT 'total' AS kind, '' AS key, sum(usd)::DOUBLE AS usd, coalesce(sum(usd) FILTER (day = '2000-06-30'), 0)::DOUBLE AS today_usd FROM win
    UNION ALL SELECT 'day', day, sum(usd)::DOUBLE, NULL FROM win GROUP BY day
    UNION ALL SELECT 'issuer', issuer, sum(usd)::DOUBLE, NULL FROM win GROUP BY issuer
    UNION ALL SELECT 'plan', plan, sum(usd)::DOUBLE, NULL FROM win WHERE plan IS NOT NULL GROUP BY plan""",
)
def cost_totals_d9(spark, d):
    o = read_sample(spark, d, "orders")
    rows = o.select(
        F.col("o_orderdate").alias("completed_at"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("issued_by"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("s"), F.col("o_orderstatus"))).alias("plan_id"),
        F.col("o_totalprice").alias("cost_usd"),
    )
    return costs.cost_totals(rows, _now(), 3650)


def _per_day(spark, d):
    o = read_sample(spark, d, "orders").filter(F.col("o_orderstatus") == "F")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("usd")
    )


_PER_DAY = "per_day AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(o_totalprice::DECIMAL(28,6))::DOUBLE AS usd FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


@query(
    "fill_days_e24",
    f"""WITH {_PER_DAY} SELECT strftime(x, '%Y-%m-%d') AS day, coalesce(usd, 0) AS usd
    FROM (SELECT unnest(generate_series(DATE '2000-06-30' - 89, DATE '2000-06-30', INTERVAL 1 DAY)) AS x) LEFT JOIN per_day ON per_day.day = strftime(x, '%Y-%m-%d')""",
)
def fill_days_e24(spark, d):
    return costs.fill_days(_per_day(spark, d), TODAY, 90)


@query(
    "run_rate_e25",
    f"""WITH {_PER_DAY}, w AS (SELECT sum(usd::DECIMAL(28,6))::DOUBLE AS total_usd, min(day) AS since FROM per_day WHERE usd > 0 AND day >= '2000-06-01')
    SELECT total_usd, date_diff('day', since::DATE, DATE '2000-06-30') + 1 AS elapsed_days,
    round(CASE WHEN date_diff('day', since::DATE, DATE '2000-06-30') + 1 >= 3 THEN total_usd / (date_diff('day', since::DATE, DATE '2000-06-30') + 1) * 30 END, 4) AS run_rate_usd FROM w""",
)
def run_rate_e25(spark, d):
    # Days after today are not part of the window either way; the test data runs on past it.
    return costs.run_rate(_per_day(spark, d), TODAY, 30).withColumn("run_rate_usd", F.round("run_rate_usd", 4))


_PLANS = """plans AS (SELECT 'p' || lpad(o_orderkey::VARCHAR, 12, '0') AS plan_id, o_orderstatus <> 'P' AS has_budget,
  CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN -1.0 WHEN '3-MEDIUM' THEN 'nan'::DOUBLE ELSE o_totalprice / 10 END AS max_cost_usd,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 20 END AS soft_limit_usd, 'pause' AS on_exceed FROM orders)"""
_LIMITS = """limits AS (SELECT plan_id, CASE WHEN c IS NULL THEN NULL WHEN isnan(c) THEN 0 ELSE greatest(c, 0) END AS cap_usd,
  CASE WHEN has_budget AND soft_limit_usd IS NOT NULL THEN greatest(soft_limit_usd, 0) END AS soft_usd, CASE WHEN has_budget THEN on_exceed ELSE 'cancel' END AS action
  FROM (SELECT *, CASE WHEN isnan(c0) THEN 30000.0 ELSE least(c0, 30000.0) END AS c FROM (SELECT *, CASE WHEN has_budget THEN max_cost_usd ELSE 25000.0 END AS c0 FROM plans)))"""


def _plans(spark, d):
    o = read_sample(spark, d, "orders")
    p = F.col("o_orderpriority")
    cap = (
        F.when(p == "1-URGENT", F.lit(None).cast("double")).when(p == "2-HIGH", -1.0).when(p == "3-MEDIUM", float("nan")).otherwise(F.col("o_totalprice") / 10)
    )
    return o.select(
        F.concat(F.lit("p"), b.pad("o_orderkey")).alias("plan_id"),
        (F.col("o_orderstatus") != "P").alias("has_budget"),
        cap.alias("max_cost_usd"),
        F.when(p != "5-LOW", F.col("o_totalprice") / 20).alias("soft_limit_usd"),
        F.lit("pause").alias("on_exceed"),
    )


@query(
    "effective_budget_e2",
    f"WITH {_PLANS}, {_LIMITS} SELECT plan_id, round(cap_usd, 6) AS cap_usd, round(soft_usd, 6) AS soft_usd, action FROM limits",
)
def effective_budget_e2(spark, d):
    out = costs.effective_budget(_plans(spark, d), 25000.0, 30000.0)
    return out.withColumns({"cap_usd": F.round("cap_usd", 6), "soft_usd": F.round("soft_usd", 6)})


_STEP_ID = "l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::BIGINT || '-' || (l_extendedprice * 100)::BIGINT"


@query(
    "budget_verdicts_e1",
    f"""WITH {_PLANS}, {_LIMITS},
    steps AS (SELECT DISTINCT 'p' || lpad(l_orderkey::VARCHAR, 12, '0') AS plan_id, {_STEP_ID} AS step_id, l_shipdate AS settled_at,
      CASE WHEN l_returnflag = 'R' THEN 0 ELSE (l_extendedprice)::DECIMAL(18,6) END AS cost FROM lineitem),
    running AS (SELECT *, sum(cost) OVER (PARTITION BY plan_id ORDER BY settled_at, step_id ROWS UNBOUNDED PRECEDING) AS s FROM steps),
    j AS (SELECT r.plan_id, step_id, s::DOUBLE AS spent, (s - cost)::DOUBLE AS before, cap_usd, soft_usd FROM running r JOIN limits USING (plan_id)),
    v AS (SELECT *, CASE WHEN spent > cap_usd AND before <= cap_usd THEN 'exceeded'
      WHEN NOT coalesce(spent > cap_usd, false) AND spent > soft_usd AND before <= soft_usd THEN 'soft_crossed' END AS verdict FROM j)
    SELECT plan_id, step_id, verdict, spent, round(CASE WHEN verdict = 'exceeded' THEN cap_usd ELSE soft_usd END, 6) AS limit_usd FROM v WHERE verdict IS NOT NULL""",
)
def budget_verdicts_e1(spark, d):
    li = read_sample(spark, d, "lineitem")
    long = lambda c: c.cast("long").cast("string")
    step = F.concat_ws(
        "-",
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        long(F.col("l_quantity")),
        long(F.round(F.col("l_extendedprice") * 100)),
    )
    steps = li.select(
        F.concat(F.lit("p"), b.pad("l_orderkey")).alias("plan_id"),
        step.alias("step_id"),
        F.col("l_shipdate").alias("settled_at"),
        F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(F.col("l_extendedprice")).alias("cost_usd"),
    )
    out = costs.budget_verdicts(steps, costs.effective_budget(_plans(spark, d), 25000.0, 30000.0), distinct=True)
    return out.withColumn("limit_usd", F.round("limit_usd", 6))
