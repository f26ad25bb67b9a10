"""The corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark passages, packing.

Every stage takes the documents that the one before kept, as Parquet, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import copies, decontaminate, line_templates, minhash_forest, packing, quality
from fleetlens.llm.common import discard, scratch, stored, table

#: Least score of a document that stays; shingle size and similarity of near-duplicates; words of a benchmark pattern.
LEAST_QUALITY, SHINGLE, PERCENT, BENCHMARK_WORDS = 0.3, 5, 80, 10


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones outside the held-out fold."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(5, 0))
    return quality.score(docs, weights, name="_quality").where(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates; n_chars is counted again where it is there.

    A template recurs across groups of near-copies, so that these reach the next stage whole and shrink to one there.
    """
    out = line_templates.drop_templates(docs, name="_dropped", copies=copies.groups(docs)).drop("_dropped")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; those without an id stay."""
    gone = minhash_forest.near_duplicates(docs, n=SHINGLE, percent=PERCENT).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    out = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), window=BENCHMARK_WORDS, prefix="_scan_")
    return out.where(F.col("_scan_n_hit") == 0).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The first stage applies a model that is learned, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage leaves in the shared folder goes once its own output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
