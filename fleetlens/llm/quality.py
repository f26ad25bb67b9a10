"""Text quality by logistic regression over hashed word n-grams.

The model is fitted with follow-the-regularised-leader updates (FTRL-proximal) on a bounded sample of labelled documents: shards
of the sample are fitted side by side and their weights averaged. Scoring is a sparse dot product for each whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import byte_set, gram_hashes, mix, stored, texts, word_hashes

BITS = 18
#: Labelled documents that a model is fitted on, at most, those that are fitted in one part, and passes over them.
MAX_ROWS, SHARD_ROWS, EPOCHS = 12_000, 3_000, 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_SPACE, _WORD, _MARK = 0, 1, 2
_KIND = np.full(256, _MARK, np.uint8)
_KIND[byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])] = _WORD
_KIND[byte_set(range(0x21))] = _SPACE
_UPPER, _LOWER, _DIGIT = byte_set(range(0x41, 0x5B)), byte_set(range(0x61, 0x7B)), byte_set(range(0x30, 0x3A))


def features(raw: np.ndarray) -> np.ndarray:
    """Indices of a text's features, one for each occurrence.

    Words and runs of marks are the tokens. Features are the hashed 1- and 2-grams of tokens, the 1-, 2- and 3-grams of their
    shapes (mark by its text; word by the cases and digits in it), and whether a token repeats one of the two before it.
    """
    kind = _KIND[raw]
    if not kind.any():
        return np.zeros(0, np.int64)
    cut = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(raw)]))
    real = kind[cut[:-1]] != _SPACE
    starts, ends = cut[:-1][real], cut[1:][real]
    token = word_hashes(raw, starts, ends)
    has = lambda of: np.add.reduceat(of[raw], starts) > 0 if len(starts) else np.zeros(0, bool)
    # reduceat runs on to the next start; what stands between tokens is white space, which is in none of the sets.
    shape = has(_UPPER) + 2 * has(_LOWER) + 4 * has(_DIGIT)
    shape = np.where(kind[starts] == _MARK, token, mix(shape.astype(np.uint64) + np.uint64(101)))
    again = np.zeros(len(token), np.uint64)
    again[1:] += (token[1:] == token[:-1]).astype(np.uint64)
    again[2:] += np.uint64(2) * (token[2:] == token[:-2]).astype(np.uint64)
    parts = [gram_hashes(token, n, 11 + n) for n in (1, 2)] + [gram_hashes(shape, n, 21 + n) for n in (1, 2, 3)] + [mix(again + np.uint64(977))]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idx = pa.array([b"" if raw is None else features(raw).astype(np.int32).tobytes() for raw in texts(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("turn"), batch.column("label"), idx], ["shard", "turn", "label", "idx"])


def _sparse(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(idx, return_counts=True)
    return at, n / np.sqrt(max(1, len(idx)))


def fit_ftrl(rows: list[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal passes over (feature indices, label); the last weight is the bias."""
    dims = (1 << BITS) + 1
    z, n = np.zeros(dims), np.zeros(dims)
    data = [(np.append(at, dims - 1), np.append(v, 1.0), y) for (at, v), y in ((_sparse(i), y) for i, y in rows)]

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, v, y in data:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def _fit_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("turn")
    labels = rows.column("label").to_numpy().astype(float)
    w = fit_ftrl([(np.frombuffer(x, np.int32), y) for x, y in zip(rows.column("idx").to_pylist(), labels)])
    at = np.flatnonzero(w)
    return pa.table({"at": pa.array(at, pa.int32()), "w": pa.array(w[at], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights learned from at most max_rows labelled documents for which `usable` holds, chosen by a hash of their id.

    Null labels, ids and texts are left out; of several labels of one document the smallest counts. Without any row the weights
    are zero and every score is 0.5.
    """
    marked = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(usable & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("turn", F.xxhash64(F.lit(7), "doc_id"))
    total = marked.count()
    if total > max_rows:  # thin out first, so that the exact bound is put on few more rows than it keeps
        marked = marked.where(F.pmod("turn", F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.3 * max_rows / total)))
    sample = stored(marked.orderBy("turn").limit(max_rows), "labelled")
    # At most max_rows rows of three numbers are broadcast.
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")
    shards = max(1, -(-sample.count() // SHARD_ROWS))
    rows = rows.select(F.pmod("turn", F.lit(shards)).cast("int").alias("shard"), "turn", "label", "text")
    fitted = rows.mapInArrow(_featured, "shard int, turn long, label int, idx binary").groupBy("shard").applyInArrow(_fit_shard, "at int, w double")
    # One row a feature at most: 2^BITS + 1.
    mean = fitted.groupBy("at").agg((F.sum("w") / shards).alias("w")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[mean.column("at").to_numpy()] = mean.column("w").to_numpy()
    return out


def _scored(weights: np.ndarray, text: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, float(weights[-1]))
            for k, raw in enumerate(texts(batch.column(text))):
                if raw is not None and len(idx := features(raw)):
                    total[k] += weights[idx].sum(dtype=np.float64) / np.sqrt(len(idx))
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))))

    return run


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """docs with their score (0 to 1) after their own columns; null and empty texts have the score of the bias alone.

    A column of that name that was there already is replaced.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scored(weights, text, name), schema)


def held_out(folds: int, fold: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
