"""Set operations over per-source results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_results(*sources: DataFrame, tag: str = "source_no") -> DataFrame:
    """Everything from every source, each row tagged with the position of its source."""
    tagged = [df.withColumn(tag, F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_distinct(*sources: DataFrame) -> DataFrame:
    """Rows of all sources with exact duplicates collapsed."""
    return reduce(lambda a, b: a.unionByName(b), sources).distinct()


def never_dispatched(unscheduled: DataFrame, rows: DataFrame) -> DataFrame:
    """Steps left unscheduled that have no row, hence never ran.  Both: plan_id, step_id."""
    return unscheduled.join(rows.select("plan_id", "step_id"), ["plan_id", "step_id"], "left_anti")
