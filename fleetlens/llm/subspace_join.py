"""Near-duplicate vectors by a pigeonhole join on subspaces.

For unit vectors a cosine of t means a squared distance of 2 - 2t. A fixed rotation spreads each vector's length over all
coordinates, which are then cut into blocks. If two vectors are close, they are close in at least one block, within that block's
proportional part of the squared distance. Only a block's coordinates travel, rounded to 16 bits: each block is joined within the
cells of a grid over its leading coordinates, and what is near there, with room for the rounding, is tied into groups. Links are
within groups, so whole vectors meet by group alone, each pair once, and are verified in double precision. Equal vectors of a label
are one class, which has a key of its own and is joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import EDGE, components, mix, runs, stored

BLOCKS, GRID, SIDE = 4, 2, 3.0
#: Vectors of up to 64 numbers on one side of a group that meet in one task; fewer of longer ones.
CHUNK = 1 << 15
#: Rows of a label from which its cells are dealt in parts, and vectors of a packed row.
CELL, PACK = 1 << 20, 128
#: Steps in which coordinates travel; sides of the squares in which rows are compared.
STEPS, SQUARE = 32767, 512
#: Room for rounding in the pigeonhole bound; the verification is exact.
SLACK = 1e-9
PLACED = "key long, dim int, block int, ids binary, points binary"


def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def _budgets(dim: int, threshold: float) -> list[tuple[np.ndarray, float]]:
    """Coordinates of each block and its part of the squared distance."""
    return [(at, max(0.0, 2 - 2 * threshold + SLACK) * len(at) / dim) for at in np.array_split(np.arange(dim), min(BLOCKS, dim))]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Scaled first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for the rows from each cut to the next."""
    size = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _placed(threshold: float, parts: dict[tuple[int, int], int]):
    """Rows of each cell, packed. A pair meets in the cell whose coordinates are the larger of both homes', as a vector visits the
    next cell up where its ball reaches that. Cells of a large label are dealt in parts, which meet two by two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                reps, first = np.unique(part.column("rep").to_numpy(), return_index=True)
                part = part.take(pa.array(first))
                lab = part.column("lab").to_numpy()
                turned = _unit(part.column("vec"), int(dim)) @ rotation(int(dim))
                many = np.array([parts.get((int(x), int(dim)), 1) for x in lab])
                mine = (mix(reps.view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                rows = np.repeat(np.arange(len(reps)), np.maximum(many - 1, 1))
                # The other part that each row of a part meets; a label of one part meets itself.
                turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
                other = np.where(many[rows] == 1, 0, turn + (turn >= mine[rows]))
                low, high = np.minimum(mine[rows], other), np.maximum(mine[rows], other)
                for j, (at, budget) in enumerate(_budgets(int(dim), threshold)):
                    x, r = turned[:, at[:GRID]], np.sqrt(budget) * (1 + 1e-6) + 1e-12
                    home, reach = (np.floor(v / (SIDE * r)).astype(np.int64) for v in (x, x + r))
                    found = []
                    for corner in range(1 << x.shape[1]):
                        pick = np.array([(corner >> g) & 1 for g in range(x.shape[1])], bool)
                        real = np.all((home != reach) | ~pick, axis=1)[rows]
                        cell = np.where(pick, reach, home)[rows]
                        key = lab[rows].view(np.uint64).copy()
                        for c in (int(dim), j, *cell.T, low, high):
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.asarray(c, np.int64).astype(np.uint64))
                        found.append((key[real], rows[real]))
                    key, who = (np.concatenate(v) for v in zip(*found))
                    order = np.argsort(key, kind="stable")
                    key, who = key[order], who[order]
                    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    ends = np.concatenate([begins[1:], [len(key)]])
                    cuts = np.concatenate([np.arange(b, e, PACK) for b, e in zip(begins, ends)] + [[len(key)]]).astype(np.int64)
                    points = np.rint(turned[:, at] * STEPS).astype(np.int16)[who]
                    n = len(cuts) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]].view(np.int64)), pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, j), pa.int32()), _packed(reps[who], cuts), _packed(points, cuts)], ["key", "dim", "block", "ids", "points"])

    return run


class Ties:
    """Sets of rows that are tied together; a set's root is its smallest row."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        out = self.up[rows]
        while not np.array_equal(above := self.up[out], out):
            out = above
        self.up[rows] = out
        return out

    def tie(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.roots(x), self.roots(y)
            x, y = x[x != y], y[x != y]
            # Of several writes one holds; the others are tried again.
            self.up[np.maximum(x, y)] = np.minimum(x, y)


def _tied(points: np.ndarray, reach: float, limit: float) -> np.ndarray:
    """The root of each row, where rows within the squared distance ``limit`` are tied; such rows differ by ``reach`` at most in each
    coordinate.

    Halves along the widest coordinate are tied each, then the strips beside the cut with each other. A row of each piece is
    compared with the others first, and pairs within the piece's largest set need not meet any more.
    """
    ties = Ties(len(points))

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        # The squared distance as one product: (a, a * a, 1) by (-2 b, 1, b * b).
        a, b = points[x].astype(np.float32), points[y].astype(np.float32)
        a, b = (np.column_stack(v) for v in ((a, (a * a).sum(axis=1), np.ones_like(a[:, 0])), (-2 * b, np.ones_like(b[:, 0]), (b * b).sum(axis=1))))
        p, q = np.divmod(np.flatnonzero(a @ b.T <= limit), len(y))
        ties.tie(x[p], y[q])

    # Pieces: pairs between x and y, or within x where y is None.
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    while todo:
        x, y = todo.pop()
        if y is not None and len(x) > len(y):
            x, y = y, x
        if len(x) < (2 if y is None else 1):
            continue
        both = x if y is None else np.concatenate([x, y])
        if len(both) > 64:
            meet(x[len(x) // 2 :][:1], x if y is None else y)
        root = ties.roots(both)
        ids, n = np.unique(root, return_counts=True)
        if len(ids) == 1:
            continue
        if 4 * n.max() > len(both):
            in_x = root[: len(x)] == ids[n.argmax()]
            if y is None:
                todo.append((x[in_x], x[~in_x]))
                x = x[~in_x]
            elif in_x.any() and (root[len(x) :] == ids[n.argmax()]).any():
                todo.append((x[in_x], y[root[len(x) :] != ids[n.argmax()]]))
                x = x[~in_x]
            both = x if y is None else np.concatenate([x, y])
        other = x if y is None else y
        if len(x) * len(other) <= SQUARE * SQUARE:
            if len(x) and len(other):
                meet(x, other)
            continue
        sample = points[both[:: max(1, len(both) // 256)]].astype(np.float32)
        axis = int(sample.std(axis=0).argmax())
        cut = np.median(sample[:, axis])
        pieces = [_halves(points[v, axis], v, cut, reach) for v in ((x,) if y is None else (x, y))]
        l, r, ls, rs = pieces[0]
        l2, r2, ls2, rs2 = pieces[-1]
        work = len(ls) * len(rs2) + (len(l) ** 2 / 2 + len(r) ** 2 / 2 if y is None else len(l) * len(l2) + len(r) * len(r2) + len(rs) * len(ls2))
        if work > 0.95 * len(x) * len(other) / (2 if y is None else 1):
            for i in range(0, len(x), SQUARE):
                for k in range(i if y is None else 0, len(other), SQUARE):
                    a, b = x[i : i + SQUARE], other[k : k + SQUARE]
                    if len(np.unique(ties.roots(np.concatenate([a, b])))) > 1:
                        meet(a, b)
        elif y is None:
            todo += [(ls, rs), (l, None), (r, None)]
        else:
            todo += [(ls, rs2), (rs, ls2), (l, l2), (r, r2)]
    return ties.roots(np.arange(len(points)))


def _halves(value: np.ndarray, rows: np.ndarray, cut: float, reach: float) -> tuple[np.ndarray, ...]:
    """Rows up to the cut and above it, and those of each that lie within reach of it."""
    below = value <= cut
    return rows[below], rows[~below], rows[below & (value >= cut - reach)], rows[~below & (value <= cut + reach)]


def _grouped(threshold: float):
    """Stars that tie what is near in a block of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "dim", "block"]):
            at, budget = _budgets(rows.column("dim")[0].as_py(), threshold)[rows.column("block")[0].as_py()]
            ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.int64)
            points = np.frombuffer(b"".join(rows.column("points").to_pylist()), np.int16).reshape(-1, len(at))
            ids, first = np.unique(ids, return_index=True)
            # Each coordinate is off by half a step at most, a distance by as much times the root of their number, on both sides;
            # squares are summed in single precision.
            far = np.sqrt(budget) * STEPS + np.sqrt(len(at)) + 1
            root = _tied(points[first], far, far * far + 8 * len(at) * 2.0**-24 * STEPS**2)
            out = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]])], EDGE.names)

    return run


def _met(threshold: float):
    """Links of each class of a group, stars of the linked, and pairs of classes that share ids with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key"]):
            dim, own = rows.column("dim")[0].as_py(), rows.column("own")[0].as_py()
            left = rows.column("left").to_numpy(zero_copy_only=False).astype(bool)
            ids, size = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
            shared = rows.column("shared").to_numpy(zero_copy_only=False).astype(bool)
            unit = _unit(rows.column("vec").combine_chunks(), dim)
            ties, links = Ties(len(ids)), np.zeros(len(ids), np.int64)
            x = np.flatnonzero(left)
            y = x if own else np.flatnonzero(~left)
            for i in range(0, len(x), SQUARE):
                for k in range(i if own else 0, len(y), SQUARE):
                    u, w = x[i : i + SQUARE], y[k : k + SQUARE]
                    found = unit[u] @ unit[w].T >= threshold
                    if own and i == k:
                        found = np.triu(found, 1)
                    if not found.any():
                        continue
                    links[u] += found @ size[w]
                    links[w] += size[u] @ found
                    if len(np.unique(ties.roots(np.concatenate([u, w])))) > 1:
                        p, q = np.nonzero(found)
                        ties.tie(u[p], w[q])
                    # Classes with an id that others have too are told pair by pair, as their ids must not count twice.
                    p, q = np.nonzero(found & (shared[u][:, None] | shared[w][None, :]))
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[u[p]]), pa.array(ids[w[q]]), pa.array(np.zeros(len(p), np.int64)), pa.array(np.ones(len(p), bool))], ["a", "b", "links", "pair"])
            root, out = ties.roots(np.arange(len(ids))), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[root[out]]), pa.array(links[out]), pa.array(np.zeros(len(out), bool))], ["a", "b", "links", "pair"])

    return run


def _usable(vec: Column, label: Column) -> Column:
    whole = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & vec.isNotNull() & whole & F.exists(vec, lambda x: x != 0), F.lit(False))


def linked_vectors(rows: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of equal label and length are linked when their cosine, in double precision, reaches the threshold. Vectors that are
    null, zero, or hold null or non-finite numbers, and those without a label or an id, are linked with nothing and kept. Equal
    vectors are linked with each other. Rows that share an id are one vector of several rows: it has the links of all of them, each
    other id counts once, its own never, and components run through it. An empty table gives an empty result. Other columns are
    ignored.
    """
    kind = rows.schema[embedding].dataType
    number = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    # (Adding zero makes the two zeros one, as groups do.)
    whole = F.transform(F.col(embedding).cast(f"array<{number}>"), lambda x: x + F.lit(0.0).cast(number))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), whole.alias("vec"))
    good = rows.where(_usable(F.col("vec"), F.col("label")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vec"))
    seed, kinds = 0, None
    while kinds is None:
        keyed = good.withColumns({"lab": F.xxhash64(F.lit(seed), "label"), "rep": F.xxhash64(F.lit(seed), "label", "vec")})
        named = stored(keyed.groupBy("vec_id", "rep", "lab", "dim").agg(F.count("*").alias("rows")), "members")
        # Labels whose cells are dealt in parts; there are no more of them than parts.
        large = named.groupBy("lab", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()
        parts = {(x.lab, x.dim): -(-x.n // CELL) for x in large}
        named = named.select("vec_id", "rep", "rows")
        several = stored(named.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1").select("vec_id", "low"), "shared-ids")
        # (vec_id, rep, low) of ids with vectors in several classes; empty where ids are unique.
        mixed = stored(named.join(several, "vec_id").select("vec_id", "rep", "low"), "shared")
        many = several.select("vec_id", F.lit(1).alias("many"))
        counts = named.join(many, "vec_id", "left").groupBy("rep").agg(F.count_if(F.col("many").isNull()).alias("n"), F.coalesce(F.max(F.col("many") == 1), F.lit(False)).alias("shared"), F.sum("rows").alias("rows"))
        counts = stored(counts, "classes")
        placed = keyed.select("rep", "lab", "dim", "vec").mapInArrow(_placed(threshold, parts), PLACED)
        ties = placed.repartition("key").sortWithinPartitions("key", "dim", "block").mapInArrow(_grouped(threshold), EDGE)
        groups = components(ties, "groups").withColumnsRenamed({"vertex": "rep", "component": "group"}).hint("merge")
        # Classes near others, and those of several rows, so that two classes of one hash are found.
        near = counts.join(groups, "rep", "left").where("group is not null or rows > 1").withColumn("group", F.coalesce("group", "rep"))
        sizes = near.groupBy("group").agg(F.count("*").alias("all")).hint("merge")
        near = stored(near.join(sizes, "group").select("rep", "n", "shared", "group", "all"), "near")
        whole = keyed.select("rep", "label", "dim", "vec").join(near, "rep").groupBy("rep", "label", "dim", "vec")
        kinds = stored(whole.agg(*[F.first(c).alias(c) for c in ("n", "shared", "group", "all")]), "kinds")
        if not kinds.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            seed, kinds = seed + 1, None  # two classes of one hash: name them all anew

    # Groups of several chunks: a class meets those of its own chunk, and of each other one.
    h = F.ceil(F.col("all") * F.greatest(F.lit(1.0), F.col("dim") / 64) / CHUNK).cast("int")
    met = kinds.where(F.col("all") > 1).withColumn("h", h).withColumn("c", F.pmod(F.xxhash64("rep"), "h").cast("int"))
    i, k = F.least("c", "o"), F.greatest("c", "o")
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumns({"left": F.col("c") <= F.col("o"), "own": F.col("c") == F.col("o"), "key": F.to_json(F.struct("group", "label", "dim", i.alias("i"), k.alias("k")))})
    met = met.select("key", "dim", "own", "left", "rep", "n", "shared", "vec").repartition("key").sortWithinPartitions("key")
    found = stored(met.mapInArrow(_met(threshold), "a long, b long, links long, pair boolean"), "links")

    same_id = mixed.select(F.col("rep").alias("a"), F.col("low").alias("b"))
    groups = components(found.select(*EDGE.names).union(same_id))
    # Ids of one class alone, in the class and in those linked with it.
    # (What grows with the table is not broadcast: a compressed size is far below what the driver would hold.)
    near = found.groupBy("a").agg(F.sum("links").alias("links")).hint("merge")
    plain = counts.join(near, counts.rep == near.a, "left").select("rep", "n", (F.col("n") + F.coalesce("links", F.lit(0))).alias("around"))
    pairs = found.where("pair").select("a", "b")
    pairs = stored(pairs.union(pairs.select("b", "a")).union(mixed.select(F.col("rep").alias("a"), F.col("rep").alias("b"))).distinct(), "pairs")
    # Ids of several classes that are seen from each class, and all that those see themselves.
    seen = pairs.join(mixed.select(F.col("rep").alias("b"), "vec_id"), "b").groupBy("a").agg(F.count_distinct("vec_id").alias("others"))
    sight = mixed.select("vec_id", F.col("rep").alias("a")).join(pairs, "a").select("vec_id", "b").distinct()
    sizes = sight.join(plain.select(F.col("rep").alias("b"), "n"), "b").groupBy("vec_id").agg(F.sum("n").alias("plain"))
    theirs = sight.join(mixed.select(F.col("rep").alias("b"), F.col("vec_id").alias("other")), "b").where("vec_id <> other").groupBy("vec_id").agg(F.count_distinct("other").alias("mixed"))
    wide = sizes.join(theirs, "vec_id", "left").select("vec_id", (F.col("plain") + F.coalesce("mixed", F.lit(0))).alias("n_wide"))
    each = named.join(plain.hint("merge"), "rep").join(seen.withColumnRenamed("a", "rep"), "rep", "left").join(groups.withColumnRenamed("vertex", "rep").hint("merge"), "rep", "left")
    each = each.select("vec_id", F.coalesce("component", "rep").alias("component"), (F.col("around") + F.coalesce("others", F.lit(0)) - 1).alias("n_links"))
    each = stored(each.groupBy("vec_id").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links")), "each")
    first = each.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    info = each.join(first.hint("merge"), "component").join(wide, "vec_id", "left").select("vec_id", F.coalesce("n_wide", "n_links").alias("n_links"), "component_id")
    out = rows.select("vec_id").join(info.hint("merge"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
