"""Plan graphs.

``nodes``: plan_id, node_id, capability, input.  ``edges``: plan_id, from_id, to_id (from depends on to).  Plans have
any number of steps.  A plan of up to ``PIECE`` rows is walked in one piece, many plans at once, which costs one pass
over its edges.  Larger plans advance by joins over all of them, one round per layer: a round reads only the edges that
are left, writes the steps it places once, and no such plan is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.plans.refs import with_output_refs
from fleetlens.session import erase, new_folder, written

# Steps and edges of a plan that is walked in one piece.
PIECE = 4096
# Steps and edges that are walked together; a batch of Arrow rows holds any number of plans.
TOGETHER = 65_536
# Fixed value: steps that a plan may have to be accepted; an argument of ``validate_plans`` only.
MAX_PLAN_STEPS = 64


def _steps(nodes: DataFrame) -> DataFrame:
    return nodes.select("plan_id", "node_id").distinct()


def plan_sizes(nodes: DataFrame) -> DataFrame:
    return _steps(nodes).groupBy("plan_id").agg(F.count("*").alias("steps"))


def dangling_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is not a step of their plan, and which end it is."""
    pairs = edges.select("plan_id", "from_id", "to_id").distinct()
    ends = F.array(
        F.struct(F.lit("from_id").alias("missing"), F.col("from_id").alias("node_id")),
        F.struct(F.lit("to_id").alias("missing"), F.col("to_id").alias("node_id")),
    )
    lost = pairs.select("*", F.inline(ends)).join(_steps(nodes), ["plan_id", "node_id"], "left_anti")
    return lost.select("plan_id", "from_id", "to_id", "missing")


def _rows(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps, then edges, as one table (plan_id, node_id, to_id, state); to_id is null for a step, state for an edge."""
    links = edges.select("plan_id", F.col("from_id").alias("node_id"), "to_id").where("to_id is not null")
    return steps.unionByName(links, allowMissingColumns=True).select("plan_id", "node_id", "to_id", "state")


def _parted(rows: DataFrame, piece: int) -> tuple[DataFrame, DataFrame | None]:
    """Plans in one row each with all their rows, and the rows of plans that are too large for that (None: there are none)."""
    large = written(rows.groupBy("plan_id").agg(F.count("*").alias("n")).where(F.col("n") > piece).select("plan_id"), "large")
    found = not large.isEmpty()
    small = rows.join(large, "plan_id", "left_anti") if found else rows
    whole = small.groupBy("plan_id").agg(F.collect_list(F.struct("node_id", "to_id", "state")).alias("rows"))
    return whole, rows.join(large, "plan_id", "left_semi") if found else None


class _Graph:
    """The plans of an Arrow batch as one graph of numbered steps."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("rows")
        sizes = lists.value_lengths().to_numpy()
        self.plan_ids, self.rows = batch.column("plan_id"), lists.flatten()
        plan = np.repeat(np.arange(len(sizes)), sizes)
        self.names = self.rows.field("node_id")
        to, self.state = self.rows.field("to_id"), self.rows.field("state")
        codes = pa.chunked_array([self.names, to]).dictionary_encode().combine_chunks()
        codes = np.concatenate([c.indices.fill_null(-1).to_numpy() for c in codes.chunks]) if isinstance(codes, pa.ChunkedArray) else codes.indices.fill_null(-1).to_numpy()
        width = int(codes.max(initial=0)) + 2
        name, end = codes[: len(plan)], codes[len(plan) :]
        self.is_step = to.is_null().to_numpy(zero_copy_only=False)
        key = plan * width + name
        self.steps, self.first = np.unique(key[self.is_step], return_index=True)
        self.first = np.flatnonzero(self.is_step)[self.first]
        self.plan = plan[self.first]
        links = ~self.is_step
        pairs = np.unique(np.stack([self.number(key[links]), self.number(plan[links] * width + end[links])], axis=1), axis=0)
        # Edges with an end that is no step hold nothing back.
        self.start, self.to = pairs[(pairs >= 0).all(axis=1)].T
        order = np.argsort(self.to, kind="stable")
        self.start, self.to = self.start[order], self.to[order]
        self.at = np.searchsorted(self.to, np.arange(len(self.steps) + 1))
        self.of_row = self.number(key)

    def number(self, key: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(key), -1)
        found = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        return np.where(self.steps[found] == key, found, -1)

    def dependents(self, front: np.ndarray) -> np.ndarray:
        """The start of every edge that leads to a step of the front."""
        size = self.at[front + 1] - self.at[front]
        skip = np.cumsum(size) - size
        return self.start[np.repeat(self.at[front] - skip, size) + np.arange(int(size.sum()))]

    def layers(self) -> np.ndarray:
        """Layer of each step, -1 for those that cannot be placed."""
        left = np.bincount(self.start, minlength=len(self.steps))
        layer = np.full(len(self.steps), -1)
        front, k = np.flatnonzero(left == 0), 0
        while len(front):
            layer[front] = k
            freed, n = np.unique(self.dependents(front), return_counts=True)
            left[freed] -= n
            front, k = freed[left[freed] == 0], k + 1
        return layer

    def skipped(self) -> np.ndarray:
        """Waiting steps that depend, over waiting steps, on one that failed."""
        flag = lambda *of: np.isin(np.asarray(self.state.to_pylist(), dtype=object), of)
        has = lambda rows: np.bincount(self.of_row[rows & self.is_step], minlength=len(self.steps)) > 0
        broken, waits = has(flag("failed", "timed_out")), has(flag("waiting"))
        hit = np.zeros(len(self.steps), bool)
        front = np.flatnonzero(broken)
        while len(front):
            reached = np.unique(self.dependents(front))
            front = reached[waits[reached] & ~hit[reached]]
            hit[front] = True
        return hit

    def columns(self, keep: np.ndarray | slice = slice(None)) -> list[pa.Array]:
        return [self.plan_ids.take(pa.array(self.plan[keep])), self.names.take(pa.array(self.first[keep]))]


def _pieces(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The plans of the batches in runs of bounded rows (a larger plan by itself), so that memory does not follow their number."""
    for batch in batches:
        ends = np.cumsum(batch.column("rows").value_lengths().to_numpy())
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + together, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _layered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        graph = _Graph(batch)
        layer = graph.layers()
        out = [*graph.columns(), pa.array(layer, pa.int64(), mask=layer < 0), pa.array(layer < 0)]
        yield pa.RecordBatch.from_arrays(out, ["plan_id", "node_id", "layer", "cycle"])


def _skipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        graph = _Graph(batch)
        yield pa.RecordBatch.from_arrays(graph.columns(graph.skipped()), ["plan_id", "node_id"])


def _schema(rows: DataFrame, more: str = "") -> T.StructType:
    return T.StructType([rows.schema["plan_id"], rows.schema["node_id"], *T.StructType.fromDDL(more).fields])


def topo_layers(nodes: DataFrame, edges: DataFrame, piece: int = PIECE) -> DataFrame:
    """Layer of every step (0: depends on nothing); ``cycle`` marks steps that cannot be placed.

    A step is placed once none of its dependencies is open.  What stays open when nothing more can be placed lies on or
    behind a cycle.  Edges that are repeated, or have an end that is no step of the plan, change nothing.
    """
    rows = written(_rows(_steps(nodes).select("*", F.lit(None).cast("string").alias("state")), edges), "graph")
    whole, large = _parted(rows, piece)
    out = whole.mapInArrow(_layered, _schema(rows, "layer bigint, cycle boolean"))
    return out if large is None else out.unionByName(_layer_rounds(large))


def _layer_rounds(rows: DataFrame) -> DataFrame:
    """Layers of plans of any size, one round each; the edges are written anew when half of them are spent."""
    key = ["plan_id", "node_id"]
    steps = written(rows.where("to_id is null").select(*key).distinct(), "steps")
    inner = rows.where("to_id is not null").select("plan_id", F.col("node_id").alias("from_id"), "to_id").distinct()
    for end in ("from_id", "to_id"):
        inner = inner.join(steps.withColumnRenamed("node_id", end), ["plan_id", end], "left_semi")
    live = written(inner, "live")
    waits = written(live.groupBy("plan_id", F.col("from_id").alias("node_id")).agg(F.count("*").alias("open")), "waits")
    spark, placed, layer = rows.sparkSession, new_folder(rows.sparkSession, "placed"), 0
    front = steps.join(waits, key, "left_anti")
    held = waits.agg(F.sum("open")).first()[0] or 0
    while True:
        front.write.parquet(f"{placed}/layer={layer}")
        front = spark.read.schema(steps.schema).parquet(f"{placed}/layer={layer}")
        if front.isEmpty():
            break
        ends = front.withColumnRenamed("node_id", "to_id")
        freed = live.join(ends, ["plan_id", "to_id"]).groupBy("plan_id", F.col("from_id").alias("node_id")).agg(F.count("*").alias("freed"))
        after = waits.where("open > 0").join(freed, key, "left").select(*key, (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open"))
        before, waits = waits, written(after, "waits")
        erase(before)
        left = waits.agg(F.sum("open")).first()[0] or 0
        if 2 * left <= held:
            # An edge is spent when its end is placed, and then no longer counted by its start.
            open_starts = waits.where("open > 0").select("plan_id", F.col("node_id").alias("from_id"))
            before, live, held = live, written(live.join(open_starts, ["plan_id", "from_id"], "left_semi").join(ends, ["plan_id", "to_id"], "left_anti"), "live"), left
            erase(before)
        front, layer = waits.where("open = 0").select(*key), layer + 1
    done = spark.read.schema(T.StructType([*steps.schema.fields, T.StructField("layer", T.LongType())])).parquet(placed)
    stuck = waits.where("open > 0").select(*key, F.lit(None).cast("long").alias("layer"), F.lit(True).alias("cycle"))
    return done.select(*key, "layer", F.lit(False).alias("cycle")).unionByName(stuck)


def ready_steps(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Waiting steps all of whose dependencies are done.  ``states``: plan_id, node_id, state."""
    unfinished = states.filter(F.col("state") != "done").select("plan_id", F.col("node_id").alias("to_id"))
    blocked = edges.join(unfinished, ["plan_id", "to_id"], "left_semi").select("plan_id", F.col("from_id").alias("node_id"))
    waiting = states.filter(F.col("state") == "waiting").select("plan_id", "node_id")
    return waiting.join(blocked, ["plan_id", "node_id"], "left_anti")


def skip_cascade(edges: DataFrame, states: DataFrame, piece: int = PIECE) -> DataFrame:
    """Steps that will never run because something they depend on failed; settled steps stay as they are.

    A skip moves from the failed steps to what depends on them, through waiting steps only.
    """
    known = states.select("plan_id", "node_id", F.col("state").cast("string").alias("state"))
    broken = known.filter(F.col("state").isin("failed", "timed_out")).select("plan_id").distinct()
    rows = written(_rows(known, edges).join(broken, "plan_id", "left_semi"), "graph")
    whole, large = _parted(rows, piece)
    out = whole.mapInArrow(_skipped, _schema(rows))
    return out if large is None else out.unionByName(_skip_rounds(large))


def _skip_rounds(rows: DataFrame) -> DataFrame:
    """Each round moves one dependency further; edges of steps that are reached are left out of the next."""
    key = ["plan_id", "node_id"]
    known = rows.where("to_id is null")
    waiting = known.filter(F.col("state") == "waiting").select("plan_id", F.col("node_id").alias("from_id")).distinct()
    inner = rows.where("to_id is not null").select("plan_id", F.col("node_id").alias("from_id"), "to_id").distinct()
    # Only edges that a skip can travel along: from the step that waits to what it waits for.
    live = written(inner.join(waiting, ["plan_id", "from_id"], "left_semi"), "live")
    front = known.filter(F.col("state").isin("failed", "timed_out")).select(*key).distinct()
    spark, reached, step = rows.sparkSession, new_folder(rows.sparkSession, "skipped"), 0
    while True:
        hit = live.join(front.withColumnRenamed("node_id", "to_id"), ["plan_id", "to_id"], "left_semi")
        hit.select("plan_id", F.col("from_id").alias("node_id")).distinct().write.parquet(f"{reached}/step={step}")
        front = spark.read.schema(_schema(rows)).parquet(f"{reached}/step={step}")
        if front.isEmpty():
            return spark.read.schema(_schema(rows)).parquet(*[f"{reached}/step={k}" for k in range(step + 1)])
        before, live = live, written(live.join(front.withColumnRenamed("node_id", "from_id"), ["plan_id", "from_id"], "left_anti"), "live")
        erase(before)
        step += 1


def validate_plans(
    plans: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    capabilities: DataFrame,
    required: DataFrame | None = None,
    max_steps: int = MAX_PLAN_STEPS,
) -> DataFrame:
    """Every reason a plan is not acceptable: plan_id, reason, detail.

    ``plans``: plan_id, estimated_usd, max_cost_usd, budget_usd, must_be_local.  ``capabilities``: capability, cloud.
    ``required``: capability, field - inputs a capability insists on, checked where the input holds no references.
    """
    # One pass over the steps, written once: what each holds against itself, and the references it makes.
    used = with_output_refs(nodes.select("plan_id", "node_id", "capability", "input"))
    offered = capabilities.groupBy("capability").agg(F.max("cloud").alias("cloud"))
    if required is not None:
        needs = required.groupBy("capability").agg(F.collect_set("field").alias("fields"))
        offered = offered.join(needs, "capability", "full")
    else:
        offered = offered.withColumn("fields", F.lit(None).cast("array<string>"))
    of_capability = F.concat_ws(":", "node_id", "capability")
    absent = F.filter("fields", lambda f: F.try_variant_get(F.col("v"), F.concat(F.lit("$['"), f, F.lit("']")), "variant").isNull())
    each = used.join(offered, "capability", "left").withColumn("absent", F.when((F.size("refs") == 0) & ~F.col("malformed"), absent))
    of_step = _listed(
        [(F.col("cloud").isNull(), "unknown_capability", of_capability), (F.col("malformed"), "malformed_output_ref", F.col("node_id"))]
    )
    missing = F.transform(
        F.coalesce("absent", F.array().cast("array<string>")),
        lambda f: F.struct(F.lit("schema_violation").alias("reason"), F.concat_ws(":", F.col("node_id"), f).alias("detail")),
    )
    columns = ["plan_id", "node_id", "capability", "cloud", F.array_distinct("refs.ref_id").alias("ref_ids")]
    steps = written(each.select(*columns, F.concat(of_step, missing).alias("reasons")), "steps")
    edges = written(edges.select("plan_id", "from_id", "to_id").distinct(), "edges")
    of_steps = steps.select("plan_id", F.inline("reasons"))
    local = plans.filter("must_be_local").select("plan_id").distinct()
    conflicts = steps.filter("cloud").join(local, "plan_id", "left_semi").select(
        "plan_id", F.lit("locality_conflict").alias("reason"), of_capability.alias("detail")
    )
    declared = edges.select("plan_id", F.col("from_id").alias("node_id"), F.col("to_id").alias("ref_id"))
    refs = steps.select("plan_id", "node_id", F.explode("ref_ids").alias("ref_id")).filter(F.col("ref_id").isNotNull())
    undeclared = refs.join(declared, ["plan_id", "node_id", "ref_id"], "left_anti").select(
        "plan_id", F.lit("undeclared_output_ref").alias("reason"), F.concat_ws(">", "node_id", "ref_id").alias("detail")
    )

    sized = plans.join(plan_sizes(steps), "plan_id", "left")
    of_plan = _listed(
        [
            (F.col("steps").isNull(), "empty", F.lit("")),
            (F.col("steps") > max_steps, "too_large", F.col("steps").cast("string")),
            (F.col("estimated_usd") > F.col("max_cost_usd"), "cost_exceeded", F.lit("")),
            (F.col("estimated_usd") > F.col("budget_usd"), "budget_inconsistent", F.lit("")),
        ]
    )
    # The outer form leaves an empty row where there is no reason; the plain one would test the array twice.
    found = sized.select("plan_id", F.inline_outer(of_plan)).filter(F.col("reason").isNotNull())

    dangling = dangling_refs(steps, edges).select(
        "plan_id", F.lit("dangling_edge").alias("reason"), F.concat_ws(">", "from_id", "to_id").alias("detail")
    )
    # A self edge keeps its step from ever being placed, so the layering finds it too.
    cyclic = topo_layers(steps, edges).filter("cycle").select("plan_id").distinct()
    cyclic = cyclic.select("plan_id", F.lit("cycle").alias("reason"), F.lit("").alias("detail"))
    out = found
    for more in (dangling, cyclic, of_steps, conflicts, undeclared):
        out = out.unionByName(more)
    return out.distinct()


def _listed(tests: list[tuple[Column, str, Column]]) -> Column:
    """The reasons whose test holds, as an array of (reason, detail)."""
    entries = [F.when(test, F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))) for test, reason, detail in tests]
    return F.array_compact(F.array(*entries))
