"""Budget verdicts: steps are shuffled once by plan, and plans that are split by time pass their limits at the same steps."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from fleetlens.operators import costs

STEPS = "plan_id string, step_id string, settled_at timestamp, cost_usd double"
LIMITS = "plan_id string, cap_usd double, soft_usd double"


def data():
    rnd, start = random.Random(5), datetime(2000, 1, 1)
    plan = lambda: "hot" if rnd.random() < 0.6 else f"p{rnd.randrange(9)}"
    at = lambda: None if rnd.random() < 0.1 else start + timedelta(hours=rnd.randrange(400))
    steps = [(plan(), f"s{i}", at(), rnd.choice([0.0, float("nan"), -1.0, 1.5, 4.0])) for i in range(600)]
    limits = [("hot", 500.0, 250.0), ("hot", None, 3.0), ("none", 1.0, 1.0), *((f"p{i}", i * 9.0, i * 4.0) for i in range(8))]
    return steps + steps[::3] + [(None, "s", start, 9.0)], limits


def brute(steps, limits):
    out = []
    for plan, cap, soft in limits:
        spent = 0.0
        for _, step, _, cost in sorted({str(s): s for s in steps if s[0] == plan}.values(), key=lambda s: (s[2] is not None, s[2] or datetime.min, s[1])):
            before, spent = spent, spent + (cost if cost > 0 else 0.0)
            over = cap is not None and spent > cap
            if over and before <= cap:
                out.append((plan, step, "exceeded", spent, cap))
            elif not over and spent > soft and before <= soft:
                out.append((plan, step, "soft_crossed", spent, soft))
    return sorted(out)


@pytest.mark.parametrize("piece", [20, 100_000])
def test_verdicts_of_split_plans(spark, monkeypatch, piece):
    monkeypatch.setattr(costs, "PLAN_STEPS", piece)
    steps, limits = data()
    got = costs.budget_verdicts(spark.createDataFrame(steps, STEPS).repartition(5), spark.createDataFrame(limits, LIMITS), distinct=True)
    keys = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())))
    assert keys == ({"plan_id"} if piece > 600 else {"plan_id", "plan_id, __bucket"})
    assert sorted(tuple(r) for r in got.collect()) == brute(steps, limits)
