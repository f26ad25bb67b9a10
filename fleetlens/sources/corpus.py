"""Reading a folder tree as a text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import prepare


def read_corpus(
    spark: SparkSession, root: str, glob: str | None = None, scope: str = "root", max_bytes: int | None = None
) -> DataFrame:
    """scope, path (relative to ``root``), content, mtime, size_bytes.

    Name and size are tested on the file listing, so a file that fails never is opened.  ``max_bytes`` leaves out
    larger files; ``corpus_skips`` counts them.
    """
    reader = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    files = reader.load(root)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    relative = F.substring_index("path", base, -1)
    return files.select(
        F.lit(scope).alias("scope"),
        relative.alias("path"),
        # Bytes that are not UTF-8 become replacement characters.
        F.decode("content", "UTF-8").alias("content"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size_bytes"),
    )


def corpus_skips(spark: SparkSession, root: str, max_bytes: int, glob: str | None = None, scope: str = "root") -> DataFrame:
    """How many files ``read_corpus`` leaves out for their size, and their bytes; only the listing is read."""
    reader = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    large = reader.load(root).select("length").filter(F.col("length") > max_bytes)
    return large.agg(F.lit(scope).alias("scope"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
