"""Windows that open at the first record after the previous window closed.

Such windows are neither tumbling nor session windows: where one starts depends on all earlier ones.  The exact
assignment is still computed in parallel.  Each key's records are cut into chunks.  A chunk maps the closing point
of the window it inherits to the closing point it passes on: a table of pieces, at most one for each record that
an inherited window can reach.  The tables of neighbouring chunks are composed pairwise in rounds, which gives every chunk its
inherited window, and the chunks are then assigned independently.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import fold_control, truncate_bytes
from fleetlens.operators.compose import CHUNK_ROWS, chunked, entries, several
from fleetlens.operators.ordered import Previous, RunningSum, millis_bucket, ordered_scan, top_k

# Burst suppression and request coalescing.
SUPPRESSION_WINDOW_MS = 60_000
BURST_ALLOWANCE = 10
SAMPLE_SUBJECTS = 8
SAMPLE_SUBJECT_BYTES = 128
SAMPLE_BUDGET_BYTES = 2048
DISTINCT_CAP = 64
BATCH_WINDOW_MS = 50
BATCH_CAP = 65
FLOODABLE_ACTIONS = ["shell.denied"]

_NO_CAP = 1 << 60


def _next_open(at: np.ndarray, window: int, cap: int) -> np.ndarray:
    """For a window opened at each record, the position of the record that opens the next one."""
    by_time = np.searchsorted(at, at + window, side="left")
    return np.minimum(by_time, np.arange(len(at)) + cap)


def _chunk_map(at: np.ndarray, idx: np.ndarray, window: int, cap: int) -> np.ndarray:
    """The bound of inherited closes (time, index), then pieces (up to this record) -> (time and index of the last close).

    Flat, two numbers and then four a piece: a crowded chunk has a piece a record.
    """
    n = len(at)
    following = _next_open(at, window, cap)
    last = np.where(following < n, following, np.arange(n))
    while not np.array_equal(last, last[last]):
        last = last[last]
    pieces = np.stack([at, idx, at[last] + window, idx[last] + cap], axis=1)
    # An inherited window closes before at[0] + window and before idx[0] + cap.
    return _joined(np.array([at[0] + window, idx[0] + cap]), pieces)


def _joined(bound: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """A map of the pieces that a close within ``bound`` can meet; neighbours of the same outcome are one."""
    pieces = pieces[: _place(pieces, bound[None, :])[0] + 1]
    ends = np.ones(len(pieces), dtype=bool)
    ends[:-1] = (pieces[1:, 2:] != pieces[:-1, 2:]).any(axis=1)
    return np.concatenate([bound, pieces[ends].ravel()])


def _place(pieces: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """The piece that each close (time, index) falls into; the number of pieces if it outlasts all."""
    return np.minimum(np.searchsorted(pieces[:, 0], closes[:, 0], side="left"), np.searchsorted(pieces[:, 1], closes[:, 1], side="left"))


def _assign(at: np.ndarray, idx: np.ndarray, entry: tuple[int, int] | None, window: int, cap: int):
    """Window start (time, index) of every record of a chunk."""
    n = len(at)
    starts, numbers = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    here = 0
    if entry is not None:
        here = int(min(np.searchsorted(at, entry[0], side="left"), np.searchsorted(idx, entry[1], side="left")))
        starts[:here], numbers[:here] = entry[0] - window, entry[1] - cap
    following = _next_open(at, window, cap)
    while here < n:
        end = int(following[here])
        starts[here:end], numbers[here:end] = at[here], idx[here]
        here = end
    return starts, numbers


def _passes(m: np.ndarray, entry: dict | None) -> dict:
    """The close that a chunk passes on; a window that outlasts the chunk stays as it is."""
    pieces = m[2:].reshape(-1, 4)
    k = 0 if entry is None else int(_place(pieces, np.array([[entry["at"], entry["idx"]]]))[0])
    return entry if k == len(pieces) else {"at": int(pieces[k, 2]), "idx": int(pieces[k, 3])}


def _followed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The maps of two chunks as one: what a closes is inherited by b, and what outlasts a meets the pieces of b."""
    bound, x, y = a[:2], a[2:].reshape(-1, 4), b[2:].reshape(-1, 4)
    k = _place(y, x[:, 2:])
    inside = (k < len(y))[:, None]
    closes = np.where(inside, y[np.minimum(k, len(y) - 1), 2:], x[:, 2:])
    return _joined(bound, np.concatenate([np.concatenate([x[:, :2], closes], axis=1), y]))


def _windows(points: DataFrame, keys: Sequence[str], window_ms: int, cap: int | None) -> DataFrame:
    """``points``: keys, at_ms, idx, chunk.  Returns keys, at_ms, idx, window_ms_start, window_idx."""
    limit = _NO_CAP if cap is None else cap
    keys = list(keys)
    key = F.struct(*keys)
    # A chunk holds at most as many rows as its range.
    chunks = points.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "at_ms"))).alias("p"))
    chunks = chunks.select(
        key.alias("k"),
        "chunk",
        F.transform("p", lambda x: x["at_ms"]).alias("at"),
        F.transform("p", lambda x: x["idx"]).alias("idx"),
    )
    key_type = chunks.schema["k"].dataType.simpleString()

    def to_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = [_chunk_map(np.asarray(at), np.asarray(idx), window_ms, limit) for at, idx in zip(b["at"], b["idx"])]
            yield pd.DataFrame({"k": b["k"], "chunk": b["chunk"], "first_chunk": b["first_chunk"], "m": m})

    spread = several(points, keys)
    if spread is None:
        placed = chunks.withColumn("entry", F.lit(None).cast("struct<at:bigint,idx:bigint>"))
    else:
        long_keys = spread.select(key.alias("k"), "first_chunk")
        maps = chunks.join(long_keys, "k").mapInPandas(to_maps, f"k {key_type}, chunk long, first_chunk long, m array<bigint>")
        placed = chunks.join(entries(maps, _followed, _passes, "struct<at:bigint,idx:bigint>"), ["k", "chunk"], "left")

    def to_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, at, idx, ea, ei in zip(b["k"], b["at"], b["idx"], b["enter_at"], b["enter_idx"]):
                entry = None if pd.isna(ea) else (int(ea), int(ei))
                starts, numbers = _assign(np.asarray(at), np.asarray(idx), entry, window_ms, limit)
                rows.append((k, at, idx, starts, numbers))
            yield pd.DataFrame(rows, columns=["k", "at", "idx", "starts", "numbers"])

    longs = "array<long>"
    assigned = placed.select("k", "at", "idx", F.col("entry.at").alias("enter_at"), F.col("entry.idx").alias("enter_idx")).mapInPandas(
        to_windows, f"k {key_type}, at {longs}, idx {longs}, starts {longs}, numbers {longs}"
    )
    zipped = assigned.select("k", F.inline(F.arrays_zip("at", "idx", "starts", "numbers")))
    return zipped.select(
        *[F.col(f"k.{c}").alias(c) for c in keys],
        F.col("at").alias("at_ms"),
        "idx",
        F.col("starts").alias("window_start_ms"),
        F.col("numbers").alias("window_idx"),
    )


def first_record_windows(
    df: DataFrame, keys: Sequence[str], window_ms: int, chunk_windows: int | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``window_start_ms`` to rows with ``at_ms``.

    Rows of one key and millisecond share a window, so only distinct milliseconds are chunked: ``chunk_rows`` at a time,
    or as many as ``chunk_windows`` windows have.
    """
    keys = list(keys)
    chunk_rows = chunk_windows * window_ms if chunk_windows else chunk_rows
    points = df.select(*keys, "at_ms").distinct().withColumn("idx", F.col("at_ms"))
    windows = _windows(chunked(points, keys, ["at_ms"], chunk_rows), keys, window_ms, None).select(*keys, "at_ms", "window_start_ms")
    return df.join(windows, [*keys, "at_ms"])


def suppress_bursts(
    audit: DataFrame, window_ms: int = SUPPRESSION_WINDOW_MS, allowance: int = BURST_ALLOWANCE, floodable: Sequence[str] = tuple(FLOODABLE_ACTIONS)
) -> DataFrame:
    """Let the first ``allowance`` rows per (action, actor) and window pass and turn the rest into one summary row.

    ``audit``: row_id, at_ms, action, actor, subject.  Output rows have kind ``entry`` or ``summary``.
    """
    keys = ["action", "actor"]
    flood = F.col("action").isin(*floodable)
    columns = ["row_id", "at_ms", *keys, "subject"]
    calm = audit.filter(~flood).select(*columns)
    placed = first_record_windows(audit.filter(flood).select(*columns), keys, window_ms)
    group = [*keys, "window_start_ms"]
    passed = top_k(placed, group, [F.asc("at_ms"), F.asc("row_id")], allowance).drop("rank")
    dropped = placed.join(passed.select("row_id"), "row_id", "left_anti")
    subjects = dropped.groupBy(*group, "subject").agg(
        F.count("*").alias("n"), F.min(F.struct("at_ms", "row_id")).alias("first")
    )
    named = subjects.filter(F.col("subject").isNotNull())
    # Samples are the first distinct subjects in the order seen; only the first 64 distinct ones are tracked.
    shown = top_k(named, group, [F.asc("first")], SAMPLE_SUBJECTS)
    folded = fold_control(F.col("subject"))
    short = F.when(F.octet_length(folded) <= SAMPLE_SUBJECT_BYTES, folded).otherwise(
        F.concat(truncate_bytes(folded, SAMPLE_SUBJECT_BYTES), F.lit("…"))
    )
    samples = (
        shown.withColumn("sample", short)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "sample"))).alias("s"))
        .withColumn("s", F.transform("s", lambda x: x["sample"]))
    )
    totals = subjects.groupBy(*group).agg(
        F.sum("n").alias("suppressed"), F.count(F.col("subject")).alias("distinct_all")
    )
    budgeted = F.aggregate(
        "s",
        F.struct(F.lit(2).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(0).alias("dropped")),
        lambda acc, s: F.when(
            acc["used"] + _encoded(s) > SAMPLE_BUDGET_BYTES,
            F.struct(acc["used"].alias("used"), acc["kept"].alias("kept"), (acc["dropped"] + 1).alias("dropped")),
        ).otherwise(
            F.struct(
                (acc["used"] + _encoded(s)).alias("used"),
                F.concat(acc["kept"], F.array(s)).alias("kept"),
                acc["dropped"].alias("dropped"),
            )
        ),
    )
    summary = totals.join(samples.select(*group, budgeted.alias("b")), group, "left")
    empty = {
        "suppressed_repeats": "long",
        "distinct_subjects": "long",
        "distinct_subjects_capped": "boolean",
        "sample_subjects": "array<string>",
        "sample_dropped_for_size": "int",
    }
    summary = summary.select(
        F.lit("summary").alias("kind"),
        F.lit(None).cast(audit.schema["row_id"].dataType).alias("row_id"),
        (F.col("window_start_ms") + window_ms).alias("at_ms"),
        *keys,
        F.lit(None).cast("string").alias("subject"),
        "window_start_ms",
        F.col("suppressed").alias("suppressed_repeats"),
        F.least("distinct_all", F.lit(DISTINCT_CAP)).alias("distinct_subjects"),
        (F.col("distinct_all") > DISTINCT_CAP).alias("distinct_subjects_capped"),
        F.coalesce("b.kept", F.array().cast("array<string>")).alias("sample_subjects"),
        F.coalesce("b.dropped", F.lit(0)).alias("sample_dropped_for_size"),
    )
    entries = passed.select(F.lit("entry").alias("kind"), *columns, "window_start_ms")
    plain = calm.select(F.lit("entry").alias("kind"), *columns, F.lit(None).cast("long").alias("window_start_ms"))
    kept = plain.unionByName(entries).withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    return kept.unionByName(summary)


def _encoded(sample: Column) -> Column:
    """Bytes a sample takes inside a JSON array, with its comma."""
    return F.octet_length(F.to_json(F.array(sample))) - 2 + 1


def rate_limit(requests: DataFrame, n: int, window_ms: int) -> DataFrame:
    """Admit ``n`` requests per key and window; the first one admitted after drops reports how many there were.

    ``requests``: key, at_ms, request_id, judged in event-time order.
    """
    placed = first_record_windows(requests.select("key", "at_ms", "request_id"), ["key"], window_ms)
    group = ["key", "window_start_ms"]
    admitted = top_k(placed, group, [F.asc("at_ms"), F.asc("request_id")], n)
    totals = placed.groupBy(*group).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("dropped"))
    before = ordered_scan(
        totals, ["key"], ["window_start_ms"], [Previous("dropped_before", F.col("dropped"))], millis_bucket("window_start_ms", 86_400_000)
    ).drop("dropped")
    joined = admitted.join(before, group)
    first = F.col("rank") == 1
    marks = joined.select(
        "request_id", F.when(first, F.coalesce("dropped_before", F.lit(0))).otherwise(0).alias("dropped_before")
    ).withColumn("admitted", F.lit(True))
    return placed.join(marks, "request_id", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def coalesce_requests(requests: DataFrame, window_ms: int = BATCH_WINDOW_MS, cap: int = BATCH_CAP, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Group requests of one fingerprint that arrive within a window of the first into one call; the ``cap``-th member
    sends the call at once.

    ``requests``: fingerprint, at_ms, request_id.  Adds the batch number, its size and why it was sent.
    """
    indexed = ordered_scan(
        requests.select("fingerprint", "at_ms", "request_id"),
        ["fingerprint"],
        ["at_ms", "request_id"],
        [RunningSum("idx", F.lit(1).cast("long"))],
        millis_bucket("at_ms", 60_000),
    )
    points = chunked(indexed.select("fingerprint", "at_ms", "idx"), ["fingerprint"], ["idx"], chunk_rows)
    windows = _windows(points, ["fingerprint"], window_ms, cap).select(
        "fingerprint", "idx", "window_start_ms", F.col("window_idx").alias("batch_no")
    )
    joined = indexed.join(windows, ["fingerprint", "idx"])
    sizes = joined.groupBy("fingerprint", "batch_no").agg(F.count("*").alias("batch_size"))
    return joined.join(sizes, ["fingerprint", "batch_no"]).select(
        "request_id",
        "fingerprint",
        "at_ms",
        "batch_no",
        "window_start_ms",
        "batch_size",
        F.when(F.col("batch_size") >= cap, "full").otherwise("window").alias("sent_by"),
    )


def tumbling_batches(requests: DataFrame, window: str) -> DataFrame:
    """The ordinary approximation of ``coalesce_requests`` on tumbling windows."""
    grouped = requests.groupBy("fingerprint", F.window(F.timestamp_millis("at_ms"), window)["start"].alias("window_start"))
    return grouped.agg(F.count("*").alias("batch_size"))
