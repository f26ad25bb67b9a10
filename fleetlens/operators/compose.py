"""State machines over ordered rows, worked on by many tasks a key.

A key's rows are cut into chunks of bounded size. A chunk is a map from the state it is entered with to the state it
passes on. Maps of neighbouring chunks are composed pairwise, in rounds, up to one map a key; going back down, every
chunk is told its entry. With n chunks that takes 2 log2(n) rounds of joins over one row a chunk, and no key's chunks are
gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import erase, written

CHUNK_ROWS = 65_536


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with a ``chunk`` number, written once.  ``order`` is total within a key.

    Chunks are ranges of (keys, order) of about ``rows`` rows, so a large key has several in a row and small keys share
    one.  Only the size of the whole decides how many there are.
    """
    kept = written(df, "points")
    parts = max(1, -(-kept.count() // rows))
    ranged = kept.repartitionByRange(parts, *keys, *order) if parts > 1 else kept.coalesce(1)
    out = written(ranged.withColumn("chunk", F.spark_partition_id().cast("long")), "chunks")
    erase(kept)
    return out


def several(points: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys that lie in more than one chunk, with their first one; None if there are none."""
    ends = points.groupBy(*keys).agg(F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))
    found = written(ends.filter("first_chunk < last_chunk").drop("last_chunk"), "several")
    return None if found.isEmpty() else found


def entries(
    maps: DataFrame,
    compose: Callable[[np.ndarray, np.ndarray], Any],
    apply: Callable[[np.ndarray, Any], Any],
    state: str,
) -> DataFrame:
    """(k, chunk, entry): the state that each chunk is entered with; null for the first chunk of a key.

    ``maps``: k, chunk, first_chunk, m.  ``compose(a, b)`` is the map of a followed by b, ``apply(m, entry)`` the state
    that m passes on, ``state`` its Spark type. Maps come as the arrays that Spark hands over.
    """
    shape = maps.schema["m"].dataType.simpleString()
    key = maps.schema["k"].dataType.simpleString()

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = [x if y is None else y if x is None else compose(x, y) for x, y in zip(b["x"], b["y"])]
            yield pd.DataFrame({"k": b["k"], "block": b["block"], "m": m})

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [apply(m, None if _missing(e) else e) for m, e in zip(b["m"], b["entry"])]
            yield pd.DataFrame({"k": b["k"], "block": b["block"] + 1, "entry": out})

    levels = [written(maps.select("k", (F.col("chunk") - F.col("first_chunk")).alias("block"), "m"), "maps")]
    first = maps.select("k", "first_chunk").distinct()
    top = levels[0].agg(F.max("block")).first()[0] or 0
    half = F.floor(F.col("block") / 2).alias("block")
    while top:
        now = levels[-1]
        x = now.filter("block % 2 = 0").select("k", half, F.col("m").alias("x"))
        y = now.filter("block % 2 = 1").select("k", half, F.col("m").alias("y"))
        pairs = x.join(y, ["k", "block"], "full")
        levels.append(written(pairs.mapInPandas(joined, f"k {key}, block long, m {shape}"), "maps"))
        top //= 2
    entry = levels[-1].select("k", "block", F.lit(None).cast(state).alias("entry"))
    for level in reversed(levels[:-1]):
        even = entry.withColumn("block", F.col("block") * 2)
        known = level.join(even, ["k", "block"]).select("k", "block", "m", "entry").mapInPandas(passed, f"k {key}, block long, entry {state}")
        both = even.unionByName(known).join(level.select("k", "block"), ["k", "block"], "left_semi")
        entry = written(both, "entries")
    return entry.join(first, "k").select("k", (F.col("block") + F.col("first_chunk")).alias("chunk"), "entry")


def _missing(entry: Any) -> bool:
    return entry is None or (isinstance(entry, float) and entry != entry)
