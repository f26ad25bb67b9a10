"""Idempotent keyed upserts into a Parquet table.

Rows live in hash buckets of the key.  A batch writes new files for the buckets it touches and then a manifest that names the
folder of every bucket; the table is what the newest complete manifest says.  A crash before the manifest leaves the table as
it was, and running a batch twice leaves the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.ordered import newest_by

_BUCKET = "key_bucket"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that were written completely."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def _parts(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folder of each bucket's rows; a table has as many entries as buckets."""
    versions = _versions(spark, folder)
    if not versions:
        return {}
    named = spark.read.schema("bucket int, part string").json(f"{folder}/manifest/{versions[-1]}")
    return {r.bucket: r.part for r in named.collect()}


def _read(spark: SparkSession, folder: str, parts: dict[int, str], schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{folder}/data/{part}/{_BUCKET}={b}" for b, part in sorted(parts.items())])


def read_upserted(spark: SparkSession, folder: str) -> DataFrame:
    parts = _parts(spark, folder)
    if not parts:
        raise FileNotFoundError(f"no table in {folder}")
    return _read(spark, folder, parts)


def upsert(df: DataFrame, folder: str, keys: Sequence[str], newest: Sequence[str], buckets: int = 64) -> None:
    """Insert or replace rows by key; of a batch's and the stored rows of a key the largest ``newest`` stays.

    Only the buckets that a batch touches are written anew.  The number of buckets belongs to the table: every batch
    has to name the same.
    """
    spark = df.sparkSession
    batch = newest_by(df, list(keys), F.struct(*newest)).select(*df.columns)
    parts = _parts(spark, folder)
    # At most ``buckets`` values.
    touched = sorted(r[0] for r in batch.select(_bucket(keys, buckets).alias("b")).distinct().collect())
    if not touched:
        return
    if old := {b: parts[b] for b in touched if b in parts}:
        stored = _read(spark, folder, old, df.schema).select(*df.columns)
        batch = newest_by(stored.unionByName(batch), list(keys), F.struct(*newest)).select(*df.columns)
    part = uuid.uuid4().hex
    batch = batch.withColumn(_BUCKET, _bucket(keys, buckets))
    batch.repartition(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets * 8))).write.partitionBy(_BUCKET).parquet(f"{folder}/data/{part}")
    rows = sorted((parts | dict.fromkeys(touched, part)).items())
    version = max(_versions(spark, folder), default=0) + 1
    spark.createDataFrame(rows, "bucket int, part string").coalesce(1).write.json(f"{folder}/manifest/{version}")


def sink_upsert(folder: str, keys: Sequence[str], newest: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for a stream."""

    def write(batch: DataFrame, epoch: int) -> None:
        upsert(batch, folder, keys, newest, buckets)

    return write
