"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is cut into trees. Each tree sorts all documents by its own part of the signature; neighbours in that order share
the longest common prefix, and those whose prefix reaches the least depth are candidates. The least depth follows from the
threshold, so that a pair at the threshold meets in at least one tree. Regions where many documents share that prefix are first
joined by their nearest neighbours in every order (deeper prefixes win); only documents that are still apart inside a region
are then compared with the others there, by their signatures and finally by their whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetlens.llm.common import LOWER, NOT_SPACE, components, gram_hashes, runs, stored, texts, word_bounds, word_hashes

TREES, DEPTH = 20, 6
#: Rows of a region's side that meet in one task.
CHUNK = 1024
#: Nearest neighbours of a document that the first round confirms; the second round covers all others exactly.
NEAREST = 2
_SALT = np.random.default_rng(20240601)
_MUL = (_SALT.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _SALT.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)[:, None]

SIGNED = "doc_id long, tx long, n_shingles long, k1 long, k2 long, sig binary"
PAIR = "a long, b long"


def shingle_set(raw: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of a text, A-Z lower-cased; with fewer words the whole sequence as one; without words none."""
    low = LOWER[raw]
    starts, ends = word_bounds(low, NOT_SPACE)
    words = word_hashes(low, starts, ends)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


def signature(shingles: np.ndarray) -> bytes:
    """Minima of a family of permutations, most significant byte first, so that bytes sort as numbers do."""
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            x = (shingles[i : i + 4096] ^ (shingles[i : i + 4096] >> np.uint64(32))).astype(np.uint32)
            y = x * _MUL + _ADD
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(best, y.min(axis=1), out=best)
    return best.astype(">u4").tobytes()


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, k1, k2, sig = [], [], [], []
            for raw in texts(batch.column("text")):
                s = shingle_set(raw, n) if raw is not None else np.zeros(0, np.uint64)
                size.append(len(s))
                # A set's identity: two sums over its members, each under its own mixing.
                with np.errstate(over="ignore"):
                    k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int((s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tx"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "tx", "n_shingles", "k1", "k2", "sig"])

    return run


def least_depth(share: float, miss: float = 1e-5) -> int:
    """Greatest prefix length at which a pair of this similarity shares a prefix in some tree but for the given probability."""
    needed = 1 - miss ** (1 / TREES)
    return max(1, min(DEPTH, math.floor(math.log(needed) / math.log(share)))) if share < 1 else DEPTH


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of each signature: the tree's number and its part of the signature, which together are the sort key."""
    for batch in batches:
        ids = batch.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(len(ids), TREES, DEPTH * 4)
        keys = np.empty((len(ids), TREES, DEPTH * 4 + 1), np.uint8)
        keys[:, :, 0] = np.arange(TREES)
        keys[:, :, 1:] = sig
        raw = keys.reshape(-1).tobytes()
        width = DEPTH * 4 + 1
        rows = len(ids) * TREES
        key = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([key, pa.array(np.repeat(ids, TREES), pa.int64())], ["key", "rep"])


def _adjacent(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id = np.zeros((0, DEPTH * 4 + 1), np.uint8), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([last_key, np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, -1)])
            ids = np.concatenate([last_id, batch.column("rep").to_numpy()])
            same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)  # the tree's number counts as the first byte
            shared = np.maximum(same - 1, 0) // 4
            at = np.flatnonzero(shared >= depth)
            a, b = np.minimum(ids[at], ids[at + 1]), np.maximum(ids[at], ids[at + 1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared[at].astype(np.int64))], ["a", "b", "shared"])
            last_key, last_id = keys[-1:], ids[-1:]

    return run


def _apart(n: int, percent: int, depth: int, least: float):
    """Links between different components within one block of a region.

    Pairs whose signatures agree often enough are compared by their whole sets here, most alike first. A link joins its two
    components for the rest of the block, and only links that join are returned: no more of them than rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["tree", "region", "i", "j"]):
            left = rows.column("left").to_numpy(zero_copy_only=False).astype(bool)
            tree, own = rows.column("tree")[0].as_py(), rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            ids = rows.column("rep").to_numpy()
            names, comp = np.unique(rows.column("component").to_numpy(), return_inverse=True)
            root = np.arange(len(names))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), ">u4").astype(np.uint32).reshape(len(ids), TREES, DEPTH)
            raw, sets = list(texts(rows.column("text"))), [None] * len(ids)

            def of(k: int) -> np.ndarray:
                if sets[k] is None:
                    sets[k] = shingle_set(raw[k], n)
                return sets[k]

            x = np.flatnonzero(left)
            y = x if own else np.flatnonzero(~left)
            link_a, link_b = [], []
            for p in x:
                q = y[(root[comp[y]] != root[comp[p]]) & ((ids[y] > ids[p]) | (not own))]
                if not len(q):
                    continue
                agree = sig[q] == sig[p]
                alike = agree.mean(axis=(1, 2))
                # Only in the first tree where the two share a prefix, so that each pair is compared once.
                hit = (alike >= least) & (np.argmax(agree[:, :, :depth].all(axis=2), axis=1) == tree)
                q = q[hit][np.argsort(-alike[hit], kind="stable")]
                mine = of(p)
                for lo, hi in ((0, 4), (4, 32), *((k, k + 256) for k in range(32, len(q), 256))):
                    part = q[lo:hi]
                    part = part[root[comp[part]] != root[comp[p]]]
                    if not len(part):
                        continue
                    theirs = [of(k) for k in part]
                    size = np.array([len(t) for t in theirs])
                    flat = np.concatenate(theirs)
                    found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.add.reduceat(found, np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
                    for k in part[100 * both >= percent * (len(mine) + size - both)]:
                        s, t = root[comp[p]], root[comp[k]]
                        if s != t:
                            root[root == max(s, t)] = min(s, t)
                            link_a.append(int(ids[p])), link_b.append(int(ids[k]))
            if link_a:
                yield pa.RecordBatch.from_arrays([pa.array(link_a, pa.int64()), pa.array(link_b, pa.int64())], ["a", "b"])

    return run


def _confirm(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, seen = [], {}
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for k, (ta, tb) in enumerate(zip(texts(batch.column("text_a")), texts(batch.column("text_b")))):
                if a[k] not in seen:
                    seen = {a[k]: shingle_set(ta, n)}  # rows mostly come sorted by a
                x, y = seen[a[k]], shingle_set(tb, n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked when 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the
    smallest doc_id reachable and kept marks it. Null texts and texts without words have no shingles, are linked with nothing and
    stay. Rows with equal sets are one class and enter the forest once. Rows sharing a doc_id count as one document, for which the
    text with the smallest hash enters it. Rows with a
    null doc_id have a null component_id and stay. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tx", F.xxhash64("text"))
    signed = stored(docs.mapInArrow(_sign(n), SIGNED), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = named.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2", "n_shingles"]).select("doc_id", "rep").distinct()
    reps = stored(
        named.join(classes, (named.k1 == classes.k1) & (named.k2 == classes.k2) & (named.n_shingles == classes.n_shingles) & (named.doc_id == classes.rep), "left_semi")
        .groupBy(F.col("doc_id").alias("rep"))
        .agg(F.min_by(F.struct("sig", "tx"), F.col("tx")).alias("of"))
        .select("rep", "of.sig", "of.tx"),
        "signatures",
    )
    depth = least_depth(percent / 100)
    trees = reps.mapInArrow(_grow, "key binary, rep long")
    near = stored(
        trees.repartitionByRange("key").sortWithinPartitions("key", "rep").mapInArrow(_adjacent(depth), "a long, b long, shared long").groupBy("a", "b").agg(F.count("*").alias("trees"), F.max("shared").alias("shared")),
        "neighbours",
    )
    # Regions: documents that share a prefix of the least depth in one tree.
    width = 1 + 4 * depth
    placed = trees.select(F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int").alias("tree"), F.xxhash64(F.expr(f"substring(key, 1, {width})")).alias("region"), "rep")
    crowd = placed.groupBy("tree", "region").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("tree", "region")
    regions = stored(placed.join(crowd, ["tree", "region"]), "regions")

    involved = regions.select("rep").distinct().join(reps.select("rep", F.col("tx").alias("_tx")), "rep")
    text_of = docs.join(involved, (docs.doc_id == involved.rep) & (docs.tx == involved["_tx"]), "left_semi").select("doc_id", "text")
    text_of = stored(text_of.dropDuplicates(["doc_id"]), "candidates")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = text_of.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = text_of.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return stored(pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(_confirm(n, percent), PAIR), "links")

    order = Window.partitionBy("x").orderBy(F.desc("trees"), F.desc("shared"), "y")
    ends = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "trees", "shared").union(near.select("b", "a", "trees", "shared"))
    closest = ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEAREST)
    first = components(confirm(closest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))

    second = components(stored(_rest(regions, first, reps, text_of, n, percent, depth), "links").join(first.select(F.col("vertex").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("vertex").alias("b"), F.col("component").alias("cb")), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = member.join(first.withColumnRenamed("vertex", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c1"))
    joined = joined.join(second.withColumnRenamed("vertex", "c1"), "c1", "left").select("doc_id", F.coalesce("component", "c1").alias("c2"))
    # Rows that share a doc_id but not their text lie in several classes; the smallest class stands for them.
    final = joined.groupBy("doc_id").agg(F.min("c2").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(regions: DataFrame, first: DataFrame, reps: DataFrame, text_of: DataFrame, n: int, percent: int, depth: int) -> DataFrame:
    """Links among documents of one region that the first round left in different components.

    The region's largest component need not be compared with itself; all others meet it and each other, in blocks of bounded size.
    """
    here = regions.join(first.withColumnRenamed("vertex", "rep"), "rep", "left").select("tree", "region", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = here.groupBy("tree", "region", "component").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("tree", "region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_all > n_main")
    rows = here.join(shape, ["tree", "region"])
    split = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    rows = rows.withColumns({"is_main": F.col("component") == F.col("main"), "n_rest": F.col("n_all") - F.col("n_main"), "h": F.xxhash64("rep")})
    rows = rows.withColumns({"m": split("n_main"), "r": split("n_rest")})
    rows = rows.withColumn("c", F.when(F.col("is_main"), F.pmod("h", "m")).otherwise(F.pmod("h", "r")).cast("int"))
    # Blocks (i, j): i < r a block of the rest; j < r another of them, j >= r a block of the main component.
    block = lambda i, j, left: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("left"))
    c, r, m = F.col("c"), F.col("r"), F.col("m")
    meets = F.when(F.col("is_main"), F.transform(F.sequence(F.lit(0), r - 1), lambda i: block(i, r + c, False))).otherwise(
        F.concat(
            F.transform(F.sequence(r, r + m - 1), lambda j: block(c, j, True)),
            F.transform(F.sequence(c, r - 1), lambda j: block(c, j, True)),
            F.when(c > 0, F.transform(F.sequence(F.lit(0), c - 1), lambda i: block(i, c, False))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>")),
        )
    )
    dealt = rows.select("tree", "region", "rep", "component", F.explode(meets).alias("at")).select("tree", "region", "at.i", "at.j", "at.left", "rep", "component")
    dealt = dealt.join(reps.select("rep", "sig").join(text_of.select(F.col("doc_id").alias("rep"), "text"), "rep"), "rep")
    share = percent / 100
    least = share - 5 * math.sqrt(share * (1 - share) / (TREES * DEPTH))
    keys = ["tree", "region", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "left", "rep", "component", "sig", "text").mapInArrow(_apart(n, percent, depth, least), PAIR)
