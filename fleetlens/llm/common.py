"""What the operators share: tables kept between jobs, hashed words and graph components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in _OPEN:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables made inside each open scratch().
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that stored() makes inside, but for the last one: the result must be written by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
    for path in made[:-1]:
        _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by stored()."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a document row that survives recomputation: its id and the hash of its text. Equal rows share it."""
    return [F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_tx")]


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """UTF-8 bytes of each string of an Arrow column as views on its buffer; None for null."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        null = array.is_null().to_numpy(zero_copy_only=False)
        for i in range(len(array)):
            yield None if null[i] else raw[at[i] : at[i + 1]]


def byte_set(members: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


NOT_SPACE = ~byte_set(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(raw: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = of_word[raw]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate(([0] if inside[0] else [], turn, [len(raw)] if inside[-1] else [])).astype(np.int64)
    return edges[0::2], edges[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


_POW = _powers(_BASE, BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(raw: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of the bytes at ascending marks, in blocks, so that memory does not follow the text's length."""
    out = np.zeros(len(marks), np.uint64)
    carry, done = 0, 0
    for begin in range(0, max(1, len(raw)), BLOCK):
        part = raw[begin : begin + BLOCK]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POW[: len(part)], out=sums[1:])
        last = np.searchsorted(marks, begin + len(part), side="right")
        scale = pow(_BASE, begin, 1 << 64)
        out[done:last] = np.uint64(carry) + np.uint64(scale) * sums[marks[done:last] - begin]
        carry = (carry + scale * int(sums[-1])) & 0xFFFFFFFFFFFFFFFF
        done = last
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        value = _prefix(raw, ends) - _prefix(raw, starts)
        inverse = _INV[starts % BLOCK]
        block = starts // BLOCK
        if block[-1]:
            step = pow(pow(_BASE, -1, 1 << 64), BLOCK, 1 << 64)
            inverse = inverse * _powers(step, int(block[-1]) + 1)[block]
        return mix(value * inverse)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0x632BE59BD9B4E019) -> np.ndarray:
    """Hash of each run of n words; another seed gives an independent hash."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        keyed = mix(words ^ np.uint64(seed))
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * np.uint64(seed | 1) + keyed[j : j + m]
        return mix(out)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys from sorted batches, one table a key; only the open key's rows are held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[lo].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by stars around the smallest vertex of each of its parts."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    star = [(v, r) for v in parent if (r := find(v)) != v]
    for i in range(0, len(star), 50_000):
        part = star[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in part], pa.int64()), "b": pa.array([x for _, x in part], pa.int64())})


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def components(edges: DataFrame, label: str = "components", shrink: bool = True) -> DataFrame:
    """(vertex, component) for every vertex of the edges (a, b): the smallest vertex reachable.

    Each partition first shrinks its own edges to stars; alternating large and small stars then join them across partitions.
    Minima are aggregates and every round is a written table, so no vertex's neighbours are gathered. Without shrink no Python runs.
    """
    edges = edges.select("a", "b").where("a <> b")
    now = stored(edges.mapInArrow(_forest, EDGE) if shrink else edges.distinct(), label)
    before = None
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    while True:
        # The whole 64 bits of each edge's hash, and the sums of both ends, which fall as long as anything moves.
        state = now.agg(F.count("*"), total(F.xxhash64("a", "b")), total(F.col("a")), total(F.col("b"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # The pair (a, m) itself, and every other neighbour moved to m.
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = stored(small, label)
        discard(now)
        now = after
    roots = now.select(F.col("b").alias("vertex")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots.select("vertex", F.col("vertex").alias("component")))
