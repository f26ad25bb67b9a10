"""Batches for training by optimal length buckets.

Texts are cut into pieces of at most `longest` tokens. A histogram of piece lengths over all documents, which has at most that many
entries, goes to the driver; dynamic programming finds the bucket boundaries with the least padding. Inside a bucket every piece is
padded to its boundary, and batches take as many pieces as the token budget holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONGEST, BUCKETS, BUDGET = 2048, 12, 65_536
#: Pieces that are numbered together; a bucket has as many shards as it takes.
SHARD = 50_000


def token_count(text: Column) -> Column:
    """Number of tokens of a text: runs of characters other than 0x20 and 0x09 to 0x0D; null has none."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.coalesce(flat, F.lit("")) == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most `buckets` buckets over ascending distinct lengths, with the least total padding.

    Of equally good choices the one with fewer buckets, then with smaller ends, is taken.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, np.int64)
    many = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    mass = np.concatenate(([0], np.cumsum(size * np.asarray(counts, np.int64))))
    # best[j]: least padding of the first j lengths in k buckets; the last bucket holds lengths i to j - 1 and pads to size[j - 1].
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    choice, totals = [], []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j])
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        choice.append(cut)
        totals.append(int(now[n]))
        best = now
    k, j, out = int(np.argmin(totals)), n, []
    while k >= 0:
        out.append(int(size[j - 1]))
        j, k = int(choice[k][j]), k - 1
    return out[::-1]


def pieces(docs: DataFrame, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tx, piece, start, length): consecutive pieces of each text; a text without tokens is one piece of length 0."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tx"), token_count(F.col(text).cast("string")).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")
    rows = rows.select("doc_id", "tx", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return rows.select("doc_id", "tx", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).alias("length"))


def pack(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, bucket, padded, shard, batch, slot) for every piece of every row.

    padded is the bucket's boundary, batch and slot number the pieces of a bucket's shard in the order of length and id; a batch
    has at most budget // padded pieces, at least one. Null and empty texts are a piece of length 0, which is part of the
    histogram. Rows that share an id are numbered next to each other. An empty table gives an empty result. Other columns are
    ignored.
    """
    rows = pieces(docs, longest, doc_id, text)
    # One row a length at most: 0 to longest.
    histogram = sorted((r.length, r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    ends = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets) or [longest]
    held = [sum(n for x, n in histogram if x <= e and (k == 0 or x > ends[k - 1])) for k, e in enumerate(ends)]
    shards = [max(1, -(-n // SHARD)) for n in held]
    per_batch = [max(1, budget // max(1, e)) for e in ends]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[k], k).otherwise(bucket)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumns({"padded": of([int(e) for e in ends]).cast("long"), "per_batch": of(per_batch), "shards": of(shards)})
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tx", "piece"), F.col("shards")).cast("int"))
    order = Window.partitionBy("bucket", "shard").orderBy("length", "doc_id", "tx", "piece")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    return rows.select("doc_id", "piece", "start", "length", "bucket", "padded", "shard", F.floor(F.col("place") / F.col("per_batch")).cast("int").alias("batch"), (F.col("place") % F.col("per_batch")).cast("int").alias("slot"))
