"""Heartbeats, progress frames, liveness, leadership and back-pressure."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.operators.compose import CHUNK_ROWS, chunked, entries, several
from fleetlens.operators.ordered import (
    LastKnown,
    Previous,
    RunningMax,
    RunningSum,
    newest_by,
    ordered_scan,
    seq_bucket,
    time_bucket,
    top_k,
)
from fleetlens.session import written
from fleetlens.vocab import TERMINAL_STEP_STATES

# Telemetry time-outs and limits.
PEER_TIMEOUT_MS = 6_000
RING_CAPACITY = 500
DISTINCT_CAP = 64
ANTI_FLAP_MS = 60_000
ANTI_FLAP_PENALTY = 200
BENCH_THRESHOLD = 5
BENCH_MS = 60_000
SUCCESS_ALPHA = 0.2
SUCCESS_FLOOR = 0.05


def peer_snapshot(heartbeats: DataFrame, manifests: DataFrame) -> DataFrame:
    """Newest heartbeat of every node beside its capacity; a reported total beats the manifest's."""
    load = ["seq", "ts", "queue_depth", "cpu_busy_pct", "ram_used_mb", "ram_total_mb", "in_flight", "paused", "on_battery"]
    newest = newest_by(heartbeats.select("node_id", *load), ["node_id"], F.struct("ts", "seq"))
    capacity = manifests.select("node_id", "cpu_cores", F.col("ram_total_mb").alias("manifest_ram_mb"))
    joined = capacity.join(newest, "node_id", "left")
    return joined.select(
        "node_id",
        "cpu_cores",
        "ts",
        F.coalesce("cpu_busy_pct", F.lit(0)).alias("cpu_busy_pct"),
        F.coalesce("ram_used_mb", F.lit(0)).alias("ram_used_mb"),
        F.when(F.col("ram_total_mb") > 0, F.col("ram_total_mb")).otherwise(F.col("manifest_ram_mb")).alias("ram_total_mb"),
        F.greatest(F.coalesce("queue_depth", F.lit(0)), F.coalesce(F.size("in_flight"), F.lit(0))).alias("reported_inflight"),
        F.coalesce("paused", F.lit(False)).alias("paused"),
        F.coalesce("on_battery", F.lit(False)).alias("on_battery"),
    )


def fleet_stats(snapshot: DataFrame, by: str | None = None) -> DataFrame:
    """Resource totals over the fleet, or per value of ``by``."""
    grouped = snapshot.groupBy(by) if by else snapshot.groupBy()
    return grouped.agg(
        F.count("*").alias("nodes"),
        F.sum("cpu_cores").cast("long").alias("cpu_cores"),
        F.sum("ram_total_mb").cast("long").alias("ram_total_mb"),
        F.sum("ram_used_mb").cast("long").alias("ram_used_mb"),
        F.avg("cpu_busy_pct").alias("avg_cpu_busy_pct"),
        F.max("cpu_busy_pct").cast("long").alias("max_cpu_busy_pct"),
        F.sum("reported_inflight").cast("long").alias("inflight"),
        F.count_if("paused").alias("paused_nodes"),
    )


def membership_snapshot(events: DataFrame) -> DataFrame:
    """Members after folding added, updated and evicted events.  ``events``: arrival, kind, node_id, payload."""
    moves = events.filter(F.col("kind").isin("added", "updated", "evicted"))
    newest = newest_by(moves.select("arrival", "kind", "node_id", "payload"), ["node_id"], F.col("arrival"))
    return newest.filter(F.col("kind") != "evicted").select("node_id", "arrival", "payload")


def current_leader(events: DataFrame) -> DataFrame:
    """The leader named by the last leader_changed event."""
    changes = events.filter(F.col("kind") == "leader_changed")
    return changes.agg(F.max_by("node_id", F.col("arrival")).alias("leader"), F.max("arrival").alias("arrival"))


def ring_tail(partials: DataFrame, n: int = RING_CAPACITY, reported: DataFrame | None = None) -> DataFrame:
    """The last ``n`` frames of every task with the number lost: pushed out of the ring or reported by the worker."""
    tail = top_k(partials, ["task_id"], [F.desc("seq")], n).drop("rank")
    lost = partials.groupBy("task_id").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("dropped"))
    if reported is not None:
        told = reported.groupBy("task_id").agg(F.sum("n").alias("reported"))
        lost = lost.join(told, "task_id", "left").select(
            "task_id", (F.col("dropped") + F.coalesce("reported", F.lit(0))).alias("dropped")
        )
    return tail.join(lost, "task_id")


def progress(partials: DataFrame, plan_sizes: DataFrame) -> DataFrame:
    """Fraction done per task, from its progress frames.  Lines that are not JSON objects are ignored.

    ``partials``: task_id, seq, line.  ``plan_sizes``: task_id, plan_size.  A settled step never goes back; the last
    frame that says anything about progress decides.
    """
    v = F.col("v")
    parsed = partials.select("task_id", "seq", jsonfn.parse("line").alias("v"))
    frames = parsed.select(
        "task_id",
        "seq",
        jsonfn.string_at(v, "$.step.id").alias("step_id"),
        F.coalesce(jsonfn.string_at(v, "$.step.state"), F.lit("waiting")).alias("step_state"),
        (jsonfn.text_at(v, "$.plan_summary").isNotNull() | jsonfn.text_at(v, "$.summary").isNotNull()).alias("summary"),
        jsonfn.number_at(v, "$.completed").alias("completed"),
        jsonfn.number_at(v, "$.total").alias("total"),
    )
    terminal = F.col("step_state").isin(*TERMINAL_STEP_STATES)
    steps = (
        frames.filter(F.col("step_id").isNotNull())
        .groupBy("task_id", "step_id")
        .agg(F.max(terminal).alias("settled"))
        .groupBy("task_id")
        .agg(F.count_if("settled").alias("settled_steps"), F.count("*").alias("steps_seen"))
    )
    sized = frames.join(plan_sizes.select("task_id", "plan_size"), "task_id", "left")
    size = F.coalesce("plan_size", F.lit(0))
    is_step = F.col("step_id").isNotNull()
    counts = F.col("total") > 0
    kind = F.when(is_step & (size > 0), "steps").when(~is_step & F.col("summary"), "summary").when(~is_step & counts, "count")
    last = (
        sized.withColumn("kind", kind)
        .groupBy("task_id")
        .agg(
            F.max_by(F.struct("kind", "completed", "total"), F.when(F.col("kind").isNotNull(), F.col("seq"))).alias("last"),
            F.max(size).alias("plan_size"),
        )
    )
    joined = last.join(steps, "task_id", "left")
    settled = F.coalesce("settled_steps", F.lit(0))
    fraction = (
        F.when(F.col("last.kind") == "steps", F.least(F.lit(1.0), settled / F.col("plan_size")))
        .when(F.col("last.kind") == "summary", 1.0)
        .when(F.col("last.kind") == "count", F.least(F.lit(1.0), F.col("last.completed") / F.col("last.total")))
    )
    return joined.select(
        "task_id",
        settled.alias("settled_steps"),
        F.coalesce("steps_seen", F.lit(0)).alias("steps_seen"),
        fraction.alias("fraction"),
    )


def distinct_subjects_capped(dropped: DataFrame, keys: list[str], cap: int = DISTINCT_CAP) -> DataFrame:
    """Distinct subjects per key, exact up to ``cap``; beyond it the cap is a floor and flagged as such."""
    distinct = dropped.filter(F.col("subject").isNotNull()).select(*keys, "subject").distinct()
    counted = distinct.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.select(
        *keys, F.least("n", F.lit(cap)).alias("distinct_subjects"), (F.col("n") > cap).alias("distinct_subjects_capped")
    )


def success_rate(outcomes: DataFrame, alpha: float = SUCCESS_ALPHA, floor: float = SUCCESS_FLOOR) -> DataFrame:
    """Moving average of outcomes per node, starting at 1 and never below ``floor``.

    ``outcomes``: node_id, at, outcome_id, ok.  One outcome maps a rate x to max((1-alpha)x + alpha*ok, floor).  Such
    maps compose into one map of the same form, so runs of outcomes are folded in fixed-size pieces, and the pieces
    again: no task ever holds the whole history of a node.
    """
    numbered = ordered_scan(
        outcomes.select("node_id", "at", "outcome_id", "ok"),
        ["node_id"],
        ["at", "outcome_id"],
        [RunningSum("n", F.lit(1).cast("long"))],
        time_bucket("at"),
    )
    maps = numbered.select(
        "node_id",
        (F.col("n") - 1).alias("pos"),
        F.lit(1.0 - alpha).alias("a"),
        F.when(F.col("ok"), F.lit(alpha)).otherwise(0.0).alias("b"),
        F.lit(floor).alias("c"),
    )
    piece = 16_384

    def compose(acc: Column, step: Column) -> Column:
        return F.struct(
            (step["a"] * acc["a"]).alias("a"),
            (step["a"] * acc["b"] + step["b"]).alias("b"),
            F.greatest(step["a"] * acc["c"] + step["b"], step["c"]).alias("c"),
        )

    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("c"))
    for _ in range(3):
        pieces = maps.groupBy("node_id", F.floor(F.col("pos") / piece).alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "a", "b", "c"))).alias("steps")
        )
        folded = pieces.select("node_id", "pos", F.aggregate("steps", identity, compose).alias("m"))
        maps = folded.select("node_id", "pos", "m.a", "m.b", "m.c")
    return maps.select("node_id", F.greatest(F.col("a") + F.col("b"), F.col("c")).alias("success_rate"))


def leader_by_tick(heartbeats: DataFrame) -> DataFrame:
    """Highest score per tick, ties to the lowest node id, and whether the leader changed.

    ``heartbeats``: observer, tick, node_id, score.
    """
    winners = heartbeats.groupBy("observer", "tick").agg(
        F.min_by(F.struct("node_id", "score"), F.struct(-F.col("score"), F.col("node_id"))).alias("w")
    )
    flat = winners.select("observer", "tick", F.col("w.node_id").alias("leader"), F.col("w.score").alias("score"))
    paired = ordered_scan(flat, ["observer"], ["tick"], [Previous("before", F.col("leader"))], seq_bucket("tick", 4_096))
    return paired.select("observer", "tick", "leader", "score", (~F.col("before").eqNullSafe(F.col("leader"))).alias("changed"))


def liveness(heartbeats: DataFrame, at: Column, timeout_ms: int = PEER_TIMEOUT_MS) -> DataFrame:
    """Last heartbeat per node; live while strictly less than the timeout has passed."""
    last = heartbeats.groupBy("node_id").agg(F.max("ts").alias("last_ts"))
    elapsed = F.unix_micros(at) - F.unix_micros("last_ts")
    return last.withColumn("live", elapsed < timeout_ms * 1000)


def reject_replays(frames: DataFrame) -> DataFrame:
    """Mark frames whose seq is not above everything seen before on their (node, channel).

    ``frames``: node_id, channel, arrival, seq.
    """
    scanned = ordered_scan(
        frames, ["node_id", "channel"], ["arrival"], [RunningMax("last_seen", F.col("seq"))], seq_bucket("arrival")
    )
    accepted = F.col("last_seen").isNull() | (F.col("seq") > F.col("last_seen"))
    return scanned.withColumn("accepted", accepted)


def membership_events(heartbeats: DataFrame, until: Column, timeout_ms: int = PEER_TIMEOUT_MS) -> DataFrame:
    """added / updated / evicted events implied by heartbeats up to ``until``."""
    order = ["ts", "seq"]
    beats = ordered_scan(
        heartbeats.select("node_id", "ts", "seq"), ["node_id"], order, [Previous("before", F.col("ts"))], time_bucket("ts")
    )
    silence = F.make_dt_interval(secs=F.lit(timeout_ms / 1000))
    gap = F.unix_micros("ts") - F.unix_micros("before") >= timeout_ms * 1000
    kind = F.when(F.col("before").isNull() | gap, "added").otherwise("updated")
    arrivals = beats.select("node_id", kind.alias("kind"), F.col("ts").alias("at"))
    lapses = beats.filter(gap).select("node_id", F.lit("evicted").alias("kind"), (F.col("before") + silence).alias("at"))
    last = heartbeats.groupBy("node_id").agg(F.max("ts").alias("last"))
    gone = last.filter(F.unix_micros(until) - F.unix_micros("last") >= timeout_ms * 1000).select(
        "node_id", F.lit("evicted").alias("kind"), (F.col("last") + silence).alias("at")
    )
    return arrivals.unionByName(lapses).unionByName(gone)


def pause_latch(depths: DataFrame, max_depth: float, resume_depth: float) -> DataFrame:
    """Paused from depth >= max until depth <= resume; in between the latch holds.

    ``depths``: node_id, at, seq, depth, operator_pause.
    """
    flip = F.when(F.col("depth") >= max_depth, True).when(F.col("depth") <= resume_depth, False)
    scanned = ordered_scan(depths, ["node_id"], ["at", "seq"], [LastKnown("latched", flip)], time_bucket("at"))
    latched = F.coalesce("latched", F.lit(False))
    return scanned.withColumns({"latched": latched, "paused": latched | F.coalesce("operator_pause", F.lit(False))})


def dedup_deliveries(messages: DataFrame) -> DataFrame:
    """First delivery per message id; a message without an id is never a duplicate."""
    no_id = F.coalesce("message_id", F.lit("")) == ""
    named = messages.filter(~no_id).withColumn("__id", F.col("message_id"))
    first = named.groupBy("__id").agg(F.min_by(F.struct(*messages.columns), F.col("arrival")).alias("row"))
    return first.select("row.*").unionByName(messages.filter(no_id))


def failure_streaks(outcomes: DataFrame) -> DataFrame:
    """Unbroken runs of health failures between successes.  ``outcomes``: node_id, at, outcome_id, ok."""
    scanned = ordered_scan(
        outcomes, ["node_id"], ["at", "outcome_id"], [RunningSum("island", F.when(F.col("ok"), 1).otherwise(0))], time_bucket("at")
    )
    failed = scanned.filter(~F.col("ok"))
    return failed.groupBy("node_id", "island").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("failures")
    )


def _carried(sizes: DataFrame, threshold: int, fold_parts: int) -> DataFrame:
    """(node_id, island, part, carry): the failures that are counted when each part begins."""
    keys = ["node_id", "island"]
    # Parts of an island are numbered without a gap, so a chunk has at most fold_parts of them.
    points = written(sizes.select(*keys, "part", "n", F.floor(F.col("part") / F.lit(fold_parts)).alias("chunk")), "parts")
    key = F.struct(*keys).alias("k")
    chunks = points.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    counted = lambda carry, n: F.when(carry + n >= threshold, F.lit(0).cast("long")).otherwise(carry + n)
    spread = several(points, keys)
    if spread is None:
        entered = chunks.withColumn("carry", F.lit(0).cast("long"))
    else:
        starts = F.sequence(F.lit(0).cast("long"), F.lit(threshold - 1).cast("long"))
        table = F.transform(starts, lambda c: F.aggregate("parts", c, lambda carry, p: counted(carry, p["n"])))
        maps = chunks.join(spread.select(key, "first_chunk"), "k").select("k", "chunk", "first_chunk", table.alias("m"))
        told = entries(maps, lambda a, b: [int(b[c]) for c in a], lambda m, carry: int(m[int(carry or 0)]), "bigint")
        entered = chunks.join(told, ["k", "chunk"], "left").withColumn("carry", F.coalesce("entry", F.lit(0).cast("long")))
    step = F.aggregate(
        "parts",
        F.struct(F.col("carry").alias("carry"), F.expr("cast(array() as array<struct<part:bigint,carry:bigint>>)").alias("out")),
        lambda acc, p: F.struct(
            counted(acc["carry"], p["n"]).alias("carry"),
            F.concat(acc["out"], F.array(F.struct(p["part"].alias("part"), acc["carry"].alias("carry")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return entered.select("k.*", F.inline_outer(step))


def breaker(outcomes: DataFrame, threshold: int = BENCH_THRESHOLD, bench_ms: int = BENCH_MS, fold_parts: int = 256) -> DataFrame:
    """Bench periods: a node is benched from its ``threshold``-th consecutive failure until ``bench_ms`` after its last
    one; a success ends the bench, a bench served to its end starts the count afresh.

    Between two successes the failures split at silences of ``bench_ms``.  A split part only passes on how many
    failures are counted (fewer than ``threshold``), so parts are summarised first, chunks of ``fold_parts`` parts are
    maps of that count, and the maps of an island are composed pairwise in rounds.
    """
    order = ["at", "outcome_id"]
    flagged = ordered_scan(
        outcomes.select("node_id", "at", "outcome_id", "ok"),
        ["node_id"],
        order,
        [
            Previous("before", F.col("at")),
            RunningSum("island", F.when(F.col("ok"), 1).otherwise(0).cast("long")),
        ],
        time_bucket("at"),
    )
    silent = F.unix_micros("at") - F.unix_micros("before") >= bench_ms * 1000
    parted = ordered_scan(
        flagged.withColumn("cut", F.when(silent, 1).otherwise(0).cast("long")),
        ["node_id"],
        order,
        [RunningSum("part", F.col("cut"))],
        time_bucket("at"),
    )
    fails = parted.filter(~F.col("ok"))
    keys = ["node_id", "island", "part"]
    sizes = fails.groupBy(*keys).agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    carried = _carried(sizes, threshold, fold_parts)
    benched = sizes.join(carried, keys).filter(F.col("carry") + F.col("n") >= threshold)
    early = top_k(fails.select(*keys, *order), keys, [F.asc("at"), F.asc("outcome_id")], threshold)
    trips = benched.join(early, keys).filter(F.col("rank") == threshold - F.col("carry"))
    cleared = outcomes.filter("ok").select("node_id", "at", "outcome_id")
    ends = ordered_scan(
        cleared, ["node_id"], order, [RunningSum("no", F.lit(1).cast("long"))], time_bucket("at")
    ).select("node_id", (F.col("no") - 1).alias("island"), F.col("at").alias("cleared_at"))
    served = F.col("last_at") + F.make_dt_interval(secs=F.lit(bench_ms / 1000))
    return trips.join(ends, ["node_id", "island"], "left").select(
        "node_id",
        F.col("at").alias("benched_at"),
        F.least(served, F.col("cleared_at")).alias("benched_until"),
        (F.col("carry") + F.col("n")).alias("failures"),
    )


def next_leader(standing: tuple[str | None, str | None, int], tick_ms: int, scores: dict[str, int], window_ms: int, penalty: int):
    """Who leads after a tick: the new standing, the winner and its counted score.

    A standing is the leader, the node that led before it, and until when that one counts ``penalty`` less.
    """
    leads, fallen, until = standing
    counted = {node: score - penalty * (node == fallen and tick_ms < until) for node, score in scores.items()}
    winner = min(counted, key=lambda node: (-counted[node], node))
    if winner != leads:
        standing = (winner, fallen, until) if leads is None else (winner, leads, tick_ms + window_ms)
    return standing, winner, counted[winner]


#: Stand for a leader and a penalised node that no tick of a chunk names; no node is called so.
_OTHER, _OTHER_FALLEN = "\0leader", "\0fallen"
_FOREVER = (1 << 62) - 1
_PIECE = "array<struct<leader:string,fallen:string,hi:bigint,out_leader:string,out_fallen:string,out_until:bigint,carried:boolean>>"


def _ticks(rows: Iterable[dict]) -> list[tuple[int, dict[str, int]]]:
    return [(int(t["tick_ms"]), {c["node_id"]: int(c["score"]) for c in (t["first"], t["second"]) if c is not None}) for t in rows]


def _pieces_of(outcomes: dict[tuple, list[tuple[int, tuple]]]) -> list[dict]:
    """A map as pieces: for a leader and a penalised node, what ``until`` up to ``hi`` leads to. Equal neighbours are one."""
    out = []
    for (leader, fallen), steps in outcomes.items():
        for k, (hi, to) in enumerate(steps):
            if k + 1 == len(steps) or steps[k + 1][1] != to:  # what is carried says no time of its own
                out.append(dict(leader=leader, fallen=fallen, hi=hi, out_leader=to[0], out_fallen=to[1], out_until=to[2], carried=to[3]))
    return out


def _leader_map(ticks: list[tuple[int, dict[str, int]]], window_ms: int, penalty: int) -> list[dict]:
    """What a chunk of ticks makes of every standing that it can be entered with.

    Nodes that it does not name are alike, and so are the times between two ticks at which a penalty may end. Standings
    that have become equal go on as one, so the work follows their number and the ticks until they meet.
    """
    nodes = sorted({n for _, scores in ticks for n in scores})
    # A penalty was set before the first tick, so it ends within a window of it: by the first tick after that, if there is one.
    ends = [t for t, _ in ticks[: 1 + sum(t < ticks[0][0] + window_ms for t, _ in ticks)]] + [_FOREVER]
    known: dict[tuple, tuple] = {}

    def follow(standing: tuple) -> tuple:
        path, k = [], 0
        while k < len(ticks) and (k, standing) not in known:
            path.append((k, standing))
            leader, fallen, until, carried = standing
            (l2, f2, u2), _, _ = next_leader((leader, fallen, until), ticks[k][0], ticks[k][1], window_ms, penalty)
            standing, k = (l2, f2, u2, carried and leader in (None, l2)), k + 1
        end = known[k, standing] if k < len(ticks) else standing
        known.update(dict.fromkeys(path, end))
        return end

    def outcome(standing: tuple) -> tuple:
        leader, fallen, until, carried = follow(standing)
        return leader, fallen, 0 if carried else until, carried

    return _pieces_of(
        {
            (leader, fallen): [(hi, outcome((leader, fallen, hi, True))) for hi in (ends if fallen in nodes else [_FOREVER])]
            for leader in [None, _OTHER, *nodes]
            for fallen in [None, _OTHER_FALLEN, *nodes]
        }
    )


def _led(pieces: list[dict], entry: dict | None) -> dict:
    """The standing that a map passes on."""
    return _look(_tables(pieces), entry)[0]


def _tables(pieces: list[dict]) -> dict[tuple, list[dict]]:
    out: dict[tuple, list[dict]] = {}
    for p in pieces:
        out.setdefault((p["leader"], p["fallen"]), []).append(p)
    return out


def _look(tables: dict[tuple, list[dict]], entry: dict | None) -> tuple[dict, bool]:
    leader, fallen, until = (entry["leader"], entry["fallen"], int(entry["until"])) if entry is not None else (None, None, 0)
    as_leader = leader if (leader, None) in tables else _OTHER
    as_fallen = fallen if (None, fallen) in tables else _OTHER_FALLEN
    row = next(p for p in tables[as_leader, as_fallen] if until <= p["hi"])
    own = lambda name: leader if name == _OTHER else fallen if name == _OTHER_FALLEN else name
    out = {"leader": own(row["out_leader"]), "fallen": own(row["out_fallen"]), "until": until if row["carried"] else int(row["out_until"])}
    return out, bool(row["carried"])


def _led_both(a: list[dict], b: list[dict]) -> list[dict]:
    """The map of one chunk followed by another's: every class of standings that either tells apart goes through both."""
    first, second = _tables(a), _tables(b)
    names = lambda k: list(dict.fromkeys([*[key[k] for key in first], *[key[k] for key in second]]))
    out = {}
    for leader in names(0):
        for fallen in names(1):
            ends = {p["hi"] for key, ps in (*first.items(), *second.items()) if key[1] == fallen for p in ps}
            steps = []
            for hi in sorted(ends | {_FOREVER}):
                mid, kept = _look(first, {"leader": leader, "fallen": fallen, "until": hi})
                end, still = _look(second, mid)
                kept = kept and still
                steps.append((hi, (end["leader"], end["fallen"], 0 if kept else end["until"], kept)))
            out[leader, fallen] = steps
    return _pieces_of(out)


def leader_with_antiflap(
    candidates: DataFrame, window_ms: int = ANTI_FLAP_MS, penalty: int = ANTI_FLAP_PENALTY, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Leader per tick when a node that just lost leadership is penalised for ``window_ms``.

    ``candidates``: observer, tick_ms, node_id, score.  Only the best two of a tick can win.  Ticks are cut into chunks
    of ``chunk_rows``; a chunk of a long observer is a map of standings, and the maps are composed pairwise in rounds,
    so an observer's ticks are worked on by many tasks.
    """
    two = top_k(candidates, ["observer", "tick_ms"], [F.desc("score"), F.asc("node_id")], 2)
    ticks = two.groupBy("observer", "tick_ms").agg(
        F.min_by(F.struct("node_id", "score"), "rank").alias("first"),
        F.max_by(F.struct("node_id", "score"), F.when(F.col("rank") == 2, 1)).alias("second"),
    )
    points = chunked(ticks, ["observer"], ["tick_ms"], chunk_rows)
    # A struct as key keeps the ticks without an observer together.
    key = F.struct("observer").alias("k")
    chunks = points.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("tick_ms", "first", "second"))).alias("ticks"))
    standing = "struct<leader:string,fallen:string,until:bigint>"
    spread = several(points, ["observer"])
    if spread is None:
        placed = chunks.withColumn("entry", F.lit(None).cast(standing))
    else:

        def to_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                m = [_leader_map(_ticks(rows), window_ms, penalty) for rows in b["ticks"]]
                yield pd.DataFrame({"k": b["k"], "chunk": b["chunk"], "first_chunk": b["first_chunk"], "m": m})

        maps = chunks.join(spread.select(key, "first_chunk"), "k").mapInPandas(
            to_maps, f"k struct<observer:string>, chunk long, first_chunk long, m {_PIECE}"
        )
        placed = chunks.join(entries(maps, lambda a, b: _led_both(list(a), list(b)), lambda m, entry: _led(list(m), entry), standing), ["k", "chunk"], "left")
    entered = placed.select("k.observer", "ticks", *[F.col(f"entry.{c}").alias(c) for c in ("leader", "fallen", "until")])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                standing = (None, None, 0) if pd.isna(row.until) else (row.leader, row.fallen, int(row.until))
                for at, scores in _ticks(row.ticks):
                    led = standing[0]
                    standing, winner, score = next_leader(standing, at, scores, window_ms, penalty)
                    out.append((row.observer, at, winner, score, winner != led))
            yield pd.DataFrame(out, columns=["observer", "tick_ms", "leader", "score", "changed"])

    return entered.mapInPandas(fold, "observer string, tick_ms long, leader string, score long, changed boolean")


def windowed_load(heartbeats: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Mean and peak load per node on tumbling or sliding windows; works on a stream when ``late`` sets a watermark."""
    beats = heartbeats.withWatermark("ts", late) if late else heartbeats
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = beats.groupBy("node_id", span.alias("w")).agg(
        F.count("*").alias("beats"),
        F.avg("load").alias("avg_load"),
        F.max("load").alias("max_load"),
    )
    return grouped.select("node_id", F.col("w.start").alias("window_start"), "beats", "avg_load", "max_load")
