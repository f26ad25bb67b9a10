"""Applying an expensive function once per distinct request."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.hashing import fingerprint


def batch_score(
    df: DataFrame,
    score: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    columns: Sequence[str],
    output: str,
) -> DataFrame:
    """Run ``score`` over the distinct values of ``columns`` and give every row its result.

    ``score`` receives Arrow batches with ``fingerprint`` and ``columns`` and must return ``fingerprint`` and the
    columns of the DDL string ``output``.
    """
    keyed = df.withColumn("fingerprint", fingerprint({c: F.col(c) for c in columns}))
    distinct = keyed.select("fingerprint", *columns).dropDuplicates(["fingerprint"])
    results = distinct.mapInPandas(score, f"fingerprint string, {output}")
    return keyed.join(results, "fingerprint").drop("fingerprint")
