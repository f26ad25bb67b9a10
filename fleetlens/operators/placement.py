"""Which node should run what."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.functions.numeric import clamp, saturating_sub, soft_pressure
from fleetlens.operators.compose import CHUNK_ROWS, chunked
from fleetlens.operators.ordered import RunningSum, ordered_scan, time_bucket
from fleetlens.operators.telemetry import PEER_TIMEOUT_MS, liveness
from fleetlens.session import written

# Weights of the fit score.
INFLIGHT_CORES = 0.5
DEFAULT_TASK_MB = 256
BATTERY_COST_WEIGHT = 2.0
MIN_SUCCESS_RATE = 0.05
TIE_EPSILON = 0.01
# Cells of memory and of GPU memory, at most, in which the demands of one kind are compared with nodes.
BAND_CUTS = (32, 8)


def filter_nodes(manifests: DataFrame, expression: str) -> DataFrame:
    """Nodes satisfying every predicate of ``cap:<id> node:<part of name> os:<part of os>``."""
    predicates = expression.split()
    if not predicates:
        raise ValueError("expression is empty")

    def compiled(predicate: str) -> Column:
        kind, found, want = predicate.partition(":")
        if found and kind == "cap":
            return F.array_contains("capabilities", want)
        if found and kind == "node":
            return F.contains(F.lower("hostname"), F.lit(want.lower()))
        if found and kind == "os":
            return F.contains(F.lower(F.coalesce("os", F.lit(""))), F.lit(want.lower()))
        raise ValueError(f"unsupported predicate {predicate!r}")

    return manifests.filter(reduce(and_, [compiled(p) for p in predicates]))


def version_lookup(capabilities: DataFrame, capability: str, major: int) -> DataFrame:
    """Nodes offering one major version of a capability, in node order."""
    offered = capabilities.filter((F.col("capability") == capability) & (F.col("version_major") == major))
    return offered.select("node_id").orderBy("node_id")


def advertisers(capabilities: DataFrame, capability: str) -> DataFrame:
    """Every (node, version) that offers a capability."""
    return capabilities.filter(F.col("capability") == capability).select("node_id", "version_major").orderBy("node_id")


def live_candidates(
    capabilities: DataFrame, heartbeats: DataFrame, at: Column, timeout_ms: int = PEER_TIMEOUT_MS
) -> DataFrame:
    """Capability rows of nodes heard from within the timeout."""
    live = liveness(heartbeats, at, timeout_ms).filter("live")
    return capabilities.join(live, "node_id", "left_semi")


def intersect_owners(owners: DataFrame, candidates: DataFrame) -> DataFrame:
    """Owners that are also candidates."""
    return owners.select("node_id").intersect(candidates.select("node_id"))


def scope_owners(tasks: DataFrame, scopes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The node that must run each owner-bound task, or why there is none.

    ``tasks``: id, capability, scope_field, input.  ``scopes``: scope_id, node_id.  ``candidates``: capability,
    node_id, paused (live nodes only).  Owners are first reduced to one row per (scope, capability), so a scope
    named by very many tasks costs each of them one lookup.
    """
    path = F.concat(F.lit("$['"), F.col("scope_field"), F.lit("']"))
    value = F.try_variant_get(jsonfn.parse("input"), path, "variant")
    keyed = tasks.select("id", "capability", value.alias("v")).withColumn("text", F.to_json("v"))
    is_string = F.startswith("text", F.lit('"'))
    keyed = keyed.select(
        "id",
        "capability",
        F.when(is_string, F.try_variant_get("v", "$", "string")).alias("scope_id"),
        F.when(F.col("v").isNull(), "missing_scope_field").when(~is_string, "scope_field_not_string").alias("bad"),
    )
    owners = (
        scopes.select("scope_id", "node_id")
        .join(candidates.select("capability", "node_id", "paused"), "node_id")
        .groupBy("scope_id", "capability")
        .agg(F.min(F.when(~F.col("paused"), F.col("node_id"))).alias("owner"), F.lit(True).alias("owned"))
    )
    joined = keyed.join(owners, ["scope_id", "capability"], "left")
    reason = (
        F.coalesce(F.col("bad"), F.when(F.col("owned").isNull(), "no_live_owner"))
    )
    reason = F.coalesce(reason, F.when(F.col("owner").isNull(), "resource_gated"))
    return joined.select("id", "scope_id", F.col("owner").alias("node_id"), reason.alias("reason"))


def apply_pins(candidates: DataFrame, tasks: DataFrame, scopes: DataFrame, live: DataFrame) -> DataFrame:
    """Candidates left after pins, and one row with a reason for every task left without any.

    ``candidates``: task_id, node_id.  ``tasks``: id, pin_node, pin_scope.  ``live``: node_id.
    """
    alive = live.select(F.col("node_id")).distinct()
    pins = tasks.select(F.col("id").alias("task_id"), "pin_node", "pin_scope")
    live_pin = alive.select(F.col("node_id").alias("pin_node"), F.lit(True).alias("pin_alive"))
    owners = scopes.join(alive, "node_id", "left_semi").select(F.col("scope_id").alias("pin_scope"), "node_id").distinct()
    owned = owners.select("pin_scope").distinct().withColumn("scope_owned", F.lit(True))
    judged = pins.join(live_pin, "pin_node", "left").join(owned, "pin_scope", "left")
    refusal = F.when(F.col("pin_node").isNotNull() & F.col("pin_alive").isNull(), "pinned_node_not_live").when(
        F.col("pin_scope").isNotNull() & F.col("scope_owned").isNull(), "pinned_scope_unowned"
    )
    judged = judged.select("task_id", "pin_node", "pin_scope", refusal.alias("reason"))
    open_tasks = judged.filter(F.col("reason").isNull())
    kept = candidates.join(open_tasks, "task_id").filter(
        F.col("pin_node").isNull() | (F.col("pin_node") == F.col("node_id"))
    )
    is_owner = owners.withColumn("is_owner", F.lit(True))
    kept = kept.join(is_owner, ["pin_scope", "node_id"], "left").filter(
        F.col("pin_scope").isNull() | F.col("is_owner")
    )
    kept = kept.select("task_id", "node_id", F.lit(None).cast("string").alias("reason"))
    refused = judged.filter(F.col("reason").isNotNull()).select("task_id", F.lit(None).cast("string").alias("node_id"), "reason")
    stranded = open_tasks.join(kept, "task_id", "left_anti").select(
        "task_id", F.lit(None).cast("string").alias("node_id"), F.lit("no_eligible_node").alias("reason")
    )
    return kept.unionByName(refused).unionByName(stranded)


def fit_score(task_mb: Column | None = None, load_mb: Column | None = None, task_gpu: Column | None = None) -> Column:
    """Fit of a node for a demand, from the columns of ``rank_candidates``; 0 only on a hard gate.

    The memory that must be free, that which is added to the load, and the memory of the GPU are the demand's own unless
    they are given. The score never rises with any of them.
    """
    c = F.col
    task_mb = F.coalesce(c("memory_mb"), F.lit(0)) if task_mb is None else task_mb
    load_mb = F.coalesce(c("memory_mb"), F.lit(DEFAULT_TASK_MB)) if load_mb is None else load_mb
    task_gpu = F.coalesce(c("gpu_memory_mb"), F.lit(0)) if task_gpu is None else task_gpu
    gpu_short = c("gpu_required") & (
        ~c("has_gpu")
        | ((c("gpu_total_mb") > 0) & (task_gpu > saturating_sub(c("gpu_total_mb"), c("gpu_used_mb"))))
    )
    ram_short = (c("ram_total_mb") > 0) & (task_mb > saturating_sub(c("ram_total_mb"), c("ram_used_mb")))
    pinned_out = (c("cpu_class") == "pinned") & (c("cpu_cores") > 0) & (c("cpu_pinned_count") >= c("cpu_cores"))
    gated = c("paused") | gpu_short | ram_short | pinned_out

    cores = F.greatest(c("cpu_cores"), F.lit(1)).cast("double")
    inflight = F.greatest(c("assigned_inflight"), c("reported_inflight")).cast("double")
    used = F.greatest(cores * c("cpu_busy_pct") / 100.0, inflight * INFLIGHT_CORES)
    own = F.when(c("cpu_class") == "light", 0.1).otherwise(1.0)
    memory = F.when(
        c("ram_total_mb") > 0,
        (c("ram_used_mb").cast("double") + load_mb) / c("ram_total_mb"),
    ).otherwise(0.0)
    gpu = F.when(
        c("gpu_required") & (c("gpu_total_mb") > 0), (c("gpu_used_mb").cast("double") + task_gpu) / c("gpu_total_mb")
    ).otherwise(0.0)
    weight = F.when(c("on_battery"), BATTERY_COST_WEIGHT).otherwise(1.0)
    rate = clamp(F.coalesce(c("success_rate"), F.lit(1.0)), MIN_SUCCESS_RATE, 1.0)
    score = soft_pressure((used + own) / cores) * soft_pressure(memory) * soft_pressure(gpu) * rate / weight
    return F.when(gated, 0.0).otherwise(score)


def effective_hints(tasks: DataFrame, capability_hints: DataFrame) -> DataFrame:
    """Each task's demand: the larger of its own hints and its capability's."""
    hints = capability_hints.select(
        "capability",
        F.col("cpu_class").alias("c_class"),
        F.col("memory_mb").alias("c_mem"),
        F.col("gpu_required").alias("c_gpu"),
        F.col("gpu_memory_mb").alias("c_gpu_mem"),
    )
    rank = lambda c: F.when(c == "light", 0).when(c == "heavy", 1).when(c.isNotNull(), 2).otherwise(-1)
    joined = tasks.join(hints, "capability", "left")
    return joined.withColumns(
        {
            "cpu_class": F.when(rank(F.col("cpu_class")) >= rank(F.col("c_class")), F.col("cpu_class")).otherwise(
                F.col("c_class")
            ),
            "memory_mb": F.greatest("memory_mb", "c_mem"),
            "gpu_required": F.col("gpu_required") | F.coalesce("c_gpu", F.lit(False)),
            "gpu_memory_mb": F.greatest("gpu_memory_mb", "c_gpu_mem"),
        }
    ).drop("c_class", "c_mem", "c_gpu", "c_gpu_mem")


DEMAND = ["capability", "cpu_class", "memory_mb", "gpu_required", "gpu_memory_mb"]


def _demand_id() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in DEMAND])


def _with_success(nodes: DataFrame, success: DataFrame | None) -> DataFrame:
    if success is not None:
        return nodes.join(success.select("node_id", "success_rate"), "node_id", "left")
    return nodes if "success_rate" in nodes.columns else nodes.withColumn("success_rate", F.lit(1.0))


def rank_candidates(tasks: DataFrame, nodes: DataFrame, success: DataFrame | None = None) -> DataFrame:
    """Positive fit scores of every node for every distinct demand.

    ``tasks`` carries the demand columns, ``nodes`` (one row per node and capability) a load snapshot.  Tasks with
    the same demand score the same, so nodes are ranked once per demand, not once per task.
    """
    demands = tasks.select(*DEMAND).distinct().withColumn("demand_id", _demand_id())
    nodes = _with_success(nodes, success)
    scored = demands.join(nodes, "capability").withColumn("score", fit_score())
    return scored.filter(F.col("score") > 0).select("demand_id", *DEMAND, "node_id", "score")


def candidate_bands(
    tasks: DataFrame, nodes: DataFrame, success: DataFrame | None = None, eps: float = TIE_EPSILON, cuts: tuple[int, int] = BAND_CUTS
) -> DataFrame:
    """The nodes within ``eps`` of the best score of every distinct demand: the columns of ``rank_candidates``.

    Demands of one capability, class and GPU need are dealt over cells of memory and GPU memory, of which there are no
    more than ``cuts`` allow. A node's score falls as a demand grows, so within a cell it lies between those of the
    cell's largest and smallest demand. Nodes that cannot come near the best of the lower bounds are dominated for the
    whole cell; demands are scored with the others only. The work follows nodes times cells and demands times bands.
    """
    nodes = _with_success(nodes, success)
    c = F.col
    group = F.struct("capability", "cpu_class", "gpu_required").alias("group")
    gpu = F.when(c("gpu_required"), F.coalesce(c("gpu_memory_mb"), F.lit(0))).otherwise(0)
    sizes = {"free": F.coalesce(c("memory_mb"), F.lit(0)), "load": F.coalesce(c("memory_mb"), F.lit(DEFAULT_TASK_MB)), "gpu": gpu}
    demands = tasks.select(*DEMAND).distinct().select("*", _demand_id().alias("demand_id"), group, *[v.alias(n) for n, v in sizes.items()])
    places = lambda n: F.array(*[F.lit(k / n) for k in range(1, n)])
    edges = demands.groupBy("group").agg(*[F.percentile_approx(n, places(k)).alias(f"{n}_cuts") for n, k in zip(("load", "gpu"), cuts)])
    below = lambda n: F.size(F.filter(f"{n}_cuts", lambda x: x < c(n))).alias(n)
    placed = demands.join(edges, "group").withColumn("cell", F.struct("group", below("load"), below("gpu")))
    ends = [f(n).alias(f"{tag}_{n}") for tag, f in (("least", F.min), ("most", F.max)) for n in sizes]
    cells = placed.groupBy("cell").agg(*ends).select("cell", "cell.group.*", *[f"{tag}_{n}" for tag in ("least", "most") for n in sizes])
    score = lambda tag: fit_score(c(f"{tag}_free"), c(f"{tag}_load"), c(f"{tag}_gpu"))
    bounds = cells.join(nodes, "capability").withColumns({"upper": score("least"), "lower": score("most")})
    floor = bounds.groupBy("cell").agg(F.max("lower").alias("floor"))
    held = bounds.select("cell", *[n for n in nodes.columns if n != "capability"], "upper").join(floor, "cell")
    held = written(held.filter((c("upper") > 0) & (c("upper") >= c("floor") * (1.0 - eps))).drop("upper", "floor"), "bands")
    scored = placed.select("demand_id", *DEMAND, "cell").join(held, "cell").withColumn("score", fit_score()).filter("score > 0")
    scored = scored.select("demand_id", *DEMAND, "node_id", "score")
    best = scored.groupBy("demand_id").agg(F.max("score").alias("best"))
    return scored.join(best, "demand_id").filter(c("score") >= c("best") * (1.0 - eps)).drop("best")


def pick_candidate(tasks: DataFrame, ranked: DataFrame, eps: float = TIE_EPSILON, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The node for each task: the best score, rotating over nodes within ``eps`` of it.

    ``ranked`` are all candidates or their bands.  Tasks of one demand are numbered in (issued_at, id) order and dealt
    over the tie band in node order; nodes are numbered in chunks of ``chunk_rows``.
    """
    ranked = written(ranked.select("demand_id", "node_id", "score"), "ranked")
    best = ranked.groupBy("demand_id").agg(F.max("score").alias("best"))
    band = ranked.join(best, "demand_id").filter(F.col("score") >= F.col("best") * (1.0 - eps))
    kept = chunked(band.select("demand_id", "node_id", "score"), ["demand_id"], ["node_id"], chunk_rows)
    sizes = kept.groupBy("demand_id").agg(F.count("*").alias("band_size"))
    seats = ordered_scan(kept, ["demand_id"], ["node_id"], [RunningSum("seat", F.lit(1))], F.col("chunk"))
    numbered = ordered_scan(
        tasks.select("id", "issued_at", _demand_id().alias("demand_id")),
        ["demand_id"],
        ["issued_at", "id"],
        [RunningSum("turn", F.lit(1))],
        time_bucket("issued_at", 86_400),
    )
    dealt = numbered.join(sizes, "demand_id").withColumn("seat", F.pmod(F.col("turn") - 1, F.col("band_size")) + 1)
    return dealt.join(seats, ["demand_id", "seat"]).select("id", "node_id", "score")


def node_score(nodes: DataFrame) -> DataFrame:
    """Leadership score of a node.  ``node_id`` is hexadecimal; its first four bytes break ties."""
    byte = lambda i: F.conv(F.substring("node_id", i, 2), 16, 10).cast("int")
    flag = lambda name, points: F.when(F.col(name), points).otherwise(0)
    score = (
        byte(1)
        + byte(3)
        + byte(5)
        + byte(7)
        + flag("has_local_fast_planner", 100)
        + flag("has_local_strong_planner", 200)
        + flag("has_cloud_planner_keys", 50)
        + F.col("cpu_cores") * 30
        + F.floor(F.col("ram_gb") / 16) * 50
        - flag("on_battery_unplugged", 100)
        - F.least(F.col("recently_demoted"), F.lit(1)) * 200
        - F.col("planner_error_rate_pct") * 10
    )
    return nodes.select("node_id", score.cast("long").alias("score"))
