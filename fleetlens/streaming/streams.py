"""Streaming operators.

Inputs carry their event time as a timestamp column ``ts``.  Order within a key is by event time and a tie-break
column; across micro-batches a key is served in arrival order, as the machines that produce the logs do.

Operators that work by timers drop rows that are more than ``late`` behind the newest row of earlier batches;
``write_late_rows`` keeps those in a table.  Where ``idle_ms`` is given, the state of a key is dropped once the watermark
is that far past its last row, and a later row finds a new key: it should be longer than anything a key is asked about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetlens.streaming import folds
from fleetlens.streaming.keyed import run_fold


def _at_ms(df: DataFrame) -> DataFrame:
    return df.withColumn("at_ms", F.unix_millis("ts"))


def _kept(df: DataFrame, columns: list[str], keys: list[str], fold: folds.Fold, late: str | None, idle_ms: int | None) -> DataFrame:
    """``fold`` over the columns; with ``idle_ms`` by event time, with rows up to ``late`` behind."""
    if idle_ms is None:
        return run_fold(_at_ms(df).select(*columns) if "at_ms" in columns else df.select(*columns), keys, fold)
    if late is None:
        raise ValueError("idle_ms needs the lateness of rows")
    rows = _at_ms(df.withWatermark("ts", late)).select(*dict.fromkeys([*columns, "ts", "at_ms"]))
    return run_fold(rows, keys, fold, idle_ms=idle_ms)


def write_late_rows(stream: DataFrame, late_ms: int, folder: str) -> DataStreamWriter:
    """A writer of the rows that are more than ``late_ms`` behind the newest row of earlier micro-batches.

    They go to ``folder/late``. Every batch is written under its number with the newest time so far, so a batch that is
    run again writes the same rows. Start it on the source, and with the trigger, of the query whose rows it keeps.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None
        if number:
            newest = spark.read.schema("newest long").parquet(f"{folder}/seen/batch={number - 1}").first()[0]
        behind = F.lit(False) if newest is None else F.unix_millis("ts") < newest - late_ms
        batch.filter(behind).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        now = batch.agg(F.greatest(F.max(F.unix_millis("ts")), F.lit(newest).cast("long")).alias("newest"))
        now.write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    return stream.writeStream.foreachBatch(keep)


def reject_replays(frames: DataFrame, late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """node_id, channel, arrival, seq (and ts with ``idle_ms``) -> with ``accepted``."""
    return _kept(frames, ["node_id", "channel", "arrival", "seq"], ["node_id", "channel"], folds.ReplayFold(), late, idle_ms)


def membership_events(heartbeats: DataFrame, timeout_ms: int, late: str = "0 seconds") -> DataFrame:
    """added / updated / evicted events; a silent node is evicted when the watermark passes its time-out."""
    rows = _at_ms(heartbeats.withWatermark("ts", late)).select("node_id", "ts", "at_ms", "seq")
    return run_fold(rows, ["node_id"], folds.MembershipFold(timeout_ms), timers=True)


def apply_lww(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Only the entries that change the converged state of their task."""
    return run_fold(_at_ms(events).select("task_id", "state", "at_ms", "source"), ["task_id"], folds.LwwFold(), ttl_ms=ttl_ms)


def leader_with_antiflap(ticks: DataFrame, window_ms: int, penalty: int) -> DataFrame:
    """``ticks``: observer, tick_ms and the two best candidates (first_id, first_score, second_id, second_score)."""
    columns = ["observer", "tick_ms", "first_id", "first_score", "second_id", "second_score"]
    return run_fold(ticks.select(*columns), ["observer"], folds.AntiFlapFold(window_ms, penalty))


def pause_latch(depths: DataFrame, max_depth: float, resume_depth: float, late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    return _kept(depths, ["node_id", "at_ms", "seq", "depth"], ["node_id"], folds.PauseFold(max_depth, resume_depth), late, idle_ms)


def state_changes(events: DataFrame, late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    return _kept(events, ["task_id", "at_ms", "event_id", "state"], ["task_id"], folds.StateChangeFold(), late, idle_ms)


def suppress_bursts(audit: DataFrame, window_ms: int, allowance: int, late: str = "0 seconds") -> DataFrame:
    """Rows of floodable actions; the caller passes other actions on unchanged."""
    rows = _at_ms(audit.withWatermark("ts", late)).select("action", "actor", "ts", "at_ms", "row_id", "subject")
    return run_fold(rows, ["action", "actor"], folds.BurstFold(window_ms, allowance), timers=True)


def rate_limit(requests: DataFrame, n: int, window_ms: int, late: str | None = None, idle_ms: int | None = None) -> DataFrame:
    return _kept(requests, ["key", "at_ms", "arrival", "request_id"], ["key"], folds.RateFold(n, window_ms), late, idle_ms)


def dedup_deliveries(messages: DataFrame, horizon: str) -> DataFrame:
    """First delivery per id within ``horizon``; messages without an id all pass."""
    marked = messages.withWatermark("ts", horizon)
    no_id = F.coalesce("message_id", F.lit("")) == ""
    return marked.filter(~no_id).dropDuplicatesWithinWatermark(["message_id"]).unionByName(marked.filter(no_id))


def coalesce_requests(requests: DataFrame, window_ms: int, cap: int, late: str = "0 seconds") -> DataFrame:
    rows = _at_ms(requests.withWatermark("ts", late)).select("fingerprint", "ts", "at_ms", "request_id")
    return run_fold(rows, ["fingerprint"], folds.CoalesceFold(window_ms, cap), timers=True)


def breaker(outcomes: DataFrame, threshold: int, bench_ms: int, late: str = "0 seconds") -> DataFrame:
    rows = _at_ms(outcomes.withWatermark("ts", late)).select("node_id", "ts", "at_ms", "outcome_id", "ok")
    return run_fold(rows, ["node_id"], folds.BreakerFold(threshold, bench_ms), timers=True)
