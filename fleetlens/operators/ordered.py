"""Ordered analytics that survive a hot key.

A plain window over a key sends every row of that key to one task.  The scans here split each key into
order-aligned buckets: rows are windowed inside ``(key, bucket)``, one small summary row per bucket carries the
state across buckets, and the two are joined back on ``(key, bucket)``.  Only the summaries of a key ever meet in
one task.  ``bucket`` must be non-decreasing in the order columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "__bucket"

# Spark prunes ``row_number() <= k`` on the map side up to this k (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_TOP_K = 1000


@dataclass(frozen=True)
class Previous:
    """``value`` of the preceding row of the key; NULL on its first row."""

    name: str
    value: Column


@dataclass(frozen=True)
class RunningSum:
    """Sum of ``value`` up to and including this row."""

    name: str
    value: Column


@dataclass(frozen=True)
class RunningMax:
    """Largest ``value`` strictly before this row."""

    name: str
    value: Column


@dataclass(frozen=True)
class LastKnown:
    """Latest non-null ``value`` up to and including this row."""

    name: str
    value: Column


Scan = Previous | RunningSum | RunningMax | LastKnown


def _local(scan: Scan, window: W) -> Column:
    so_far = window.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = window.rowsBetween(W.unboundedPreceding, -1)
    match scan:
        case Previous():
            return F.lag(F.struct(scan.value.alias("v"))).over(window)
        case RunningSum():
            return F.sum(scan.value).over(so_far)
        case RunningMax():
            return F.max(scan.value).over(before)
        case LastKnown():
            return F.last(scan.value, ignorenulls=True).over(so_far)


def _summary(scan: Scan, order: Column) -> Column:
    match scan:
        case Previous():
            return F.max_by(F.struct(scan.value.alias("v")), order)
        case RunningSum():
            return F.sum(scan.value)
        case RunningMax():
            return F.max(scan.value)
        case LastKnown():
            return F.max_by(scan.value, F.when(scan.value.isNotNull(), order))


def _carry(scan: Scan, column: Column, window: W) -> Column:
    before = window.rowsBetween(W.unboundedPreceding, -1)
    match scan:
        case Previous():
            return F.lag(column).over(window)
        case RunningSum():
            return F.sum(column).over(before)
        case RunningMax():
            return F.max(column).over(before)
        case LastKnown():
            return F.last(column, ignorenulls=True).over(before)


def _combined(scan: Scan, local: Column, carry: Column) -> Column:
    match scan:
        case Previous():
            return F.coalesce(local, carry)["v"]
        case RunningSum():
            return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        case RunningMax():
            return F.greatest(local, carry)
        case LastKnown():
            return F.coalesce(local, carry)


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Sequence[Scan], bucket: Column | None = None
) -> DataFrame:
    """Add one column per scan.  ``order`` is ascending and total within a key; NULLs come first and form keys of their own.

    Without ``bucket`` the plain window is used: right for keys whose groups have a small proven bound.
    """
    keys = list(keys)
    if bucket is None:
        window = W.partitionBy(*keys).orderBy(*order)
        local = {s.name: _local(s, window) for s in scans}
        return df.withColumns({s.name: local[s.name]["v"] if isinstance(s, Previous) else local[s.name] for s in scans})

    bucketed = df.withColumn(_BUCKET, bucket)
    window = W.partitionBy(*keys, _BUCKET).orderBy(*order)
    local = bucketed.withColumns({f"__l_{s.name}": _local(s, window) for s in scans})

    order_key = F.struct(*[F.col(o) for o in order])
    summary = bucketed.groupBy(*keys, _BUCKET).agg(*[_summary(s, order_key).alias(f"__s_{s.name}") for s in scans])
    across = W.partitionBy(*keys).orderBy(_BUCKET)
    carry = summary.select(
        *keys, _BUCKET, *[_carry(s, F.col(f"__s_{s.name}"), across).alias(f"__c_{s.name}") for s in scans]
    )
    # Null-safe, so that rows without a key or an order value keep their place: the first of their key.
    named = [*keys, _BUCKET]
    other = carry.select(*[F.col(c).alias(f"__k_{c}") for c in named], *[f"__c_{s.name}" for s in scans])
    same = [local[c].eqNullSafe(other[f"__k_{c}"]) for c in named]
    joined = local.join(other, same)
    return joined.select(
        *df.columns,
        *[_combined(s, F.col(f"__l_{s.name}"), F.col(f"__c_{s.name}")).alias(s.name) for s in scans],
    )


def unpack(df: DataFrame, columns: Sequence[str | Column], array: Column, *names: str) -> DataFrame:
    """``columns`` beside the position and value of every element of ``array`` (or the value alone, for one name).

    The plain explode makes the optimizer test ``size(array) > 0`` below it, which evaluates a costly array twice;
    the outer form does not, and the rows of empty arrays are dropped after it.
    """
    generator = F.explode_outer(array) if len(names) == 1 else F.posexplode_outer(array)
    out = df.select(*columns, generator.alias(*names))
    return out.filter(F.col(names[0]).isNotNull())


def seq_bucket(column: str, rows: int = 65_536) -> Column:
    """Bucket of a dense sequence number."""
    return F.floor(F.col(column) / F.lit(rows))


def time_bucket(column: str, seconds: int = 3_600) -> Column:
    """Bucket of a timestamp."""
    return F.floor(F.unix_micros(F.col(column)) / F.lit(seconds * 1_000_000))


def millis_bucket(column: str, millis: int = 3_600_000) -> Column:
    return F.floor(F.col(column) / F.lit(millis))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, ranked from 1.

    Up to ``MAP_SIDE_TOP_K`` Spark cuts each map task to k rows per key before the shuffle.  Beyond it the rows
    are first ranked inside salted sub-groups, so a hot key reaches its final task as salts x k rows.
    """
    keys = list(keys)
    final = W.partitionBy(*keys).orderBy(*order)
    if k > MAP_SIDE_TOP_K:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(64)))
        inner = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = salted.withColumn("__r", F.row_number().over(inner)).filter(F.col("__r") <= k).drop("__salt", "__r")
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "variant" not in f.dataType.simpleString() and "map" not in f.dataType.simpleString()]


def newest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the largest by ``order``.  Aggregates on the map side, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def oldest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the smallest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
