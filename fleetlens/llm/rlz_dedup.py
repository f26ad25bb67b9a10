"""Passages that repeat across documents, by a relative Lempel-Ziv parse.

Every document is a reference for those with larger ids. The reference is indexed by its blocks, which are the runs of `window`
words at every position: the index names for each block the smallest document that holds it, and where. A document is then
factored greedily from left to right: a factor starts at an indexed block and grows as long as the next block continues at the
same place of the reference; where it stops, the block across the boundary is looked up on its own, so that a passage put
together from several references is found whole. Factors are never shorter than a block; the words under them are the spans.

Most blocks occur once, and only blocks that may occur twice are worth indexing. Each block has an anchor: the smallest hash of
the `ANCHOR`-word runs inside it. Equal blocks have equal anchors, and neighbouring blocks mostly share theirs, so a document has
about a fifth as many anchors as words. Anchors seen in one document only rule out all their blocks.

Both exchanges carry packed arrays, one row for each bucket of hashes and some millions of words. A hash that many documents of
one task share is sent once; the others there know already that it is repeated. So no frequent passage gathers in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import NOT_SPACE, gram_hashes, mix, stored, texts, word_bounds, word_hashes

ANCHOR = 5
#: Bytes of text for each bucket of the exchanges, and hashes that a task packs at a time.
BUCKET_BYTES = 1 << 24
PACK = 1 << 21

_TYPES = {"h": np.uint64, "doc": np.int64, "tx": np.int64, "at": np.int32, "source": np.int64, "source_at": np.int32}
PACKED = "bucket int, " + ", ".join(f"{k} binary" for k in _TYPES)
FOUND = {"anchor": "doc_id long, h binary", "block": "doc_id long, tx long, at binary, source binary, source_at binary"}
FACTOR = "array<struct<start:int,n_words:int,source:long,source_start:int>>"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, done = x, 1
    while done * 2 <= width:
        step, done = np.minimum(step[:-done], step[done:]), done * 2
    rest = width - done
    return np.minimum(step[: len(step) - rest], step[rest:]) if rest else step


def block_hashes(words: np.ndarray, window: int) -> np.ndarray:
    return gram_hashes(words, window)


def block_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each block of the document the anchor that stands for it."""
    size = min(ANCHOR, window)
    return _sliding_min(gram_hashes(words, size, seed=0x51ED270B7F4A7C15), window - size + 1)


def _write(name: str, x: np.ndarray) -> bytes:
    """Places are written as differences: in a document's order these are small, and the exchange compresses them away."""
    return np.diff(x.astype(np.int32), prepend=np.int32(0)).tobytes() if name.endswith("at") else x.astype(_TYPES[name]).tobytes()


def _read(name: str, x: bytes) -> np.ndarray:
    out = np.frombuffer(x, _TYPES[name])
    return np.cumsum(out, dtype=np.int32) if name.endswith("at") else out


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Starts and ends of the runs of equal keys in sorted rows."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cut = np.flatnonzero(new)
    return cut, [*cut[1:].tolist(), n]


def _pack(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((*[columns[k] for k in ("at", "tx", "doc") if k in columns], bucket))
    bucket, columns = bucket[order], {k: x[order] for k, x in columns.items()}
    cut, ends = _groups([bucket])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cut], pa.int32()),
            *(pa.array([_write(k, columns[k][i:j]) for i, j in zip(cut, ends)] if k in columns else [None] * len(cut), pa.binary()) for k in _TYPES),
        ],
        ["bucket", *_TYPES],
    )


def _by_hash(h: np.ndarray, doc: np.ndarray, tx: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, document and text, the start of each hash's group, and each row's group."""
    order = np.lexsort((doc, h) if tx is None else (tx, doc, h))
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _dealt(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _send(kind: str, h: np.ndarray, doc: np.ndarray, tx: np.ndarray, at: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each hash of this task goes to the index; the answers that the task knows itself pass beside it.

    Buckets from `buckets` up hold such answers: for anchors the rows that share one, for blocks those whose smallest document of
    this task is another one, with that document and place. They are dealt out by document, since nothing but a document's own
    answers has to meet. Of a block's smallest document every text is sent: each may lose words to a smaller one elsewhere.
    """
    order, starts, group = _by_hash(h, doc, tx)
    h, doc, tx, at, bucket = h[order], doc[order], tx[order], at[order], bucket[order]
    first = doc[starts][group]
    if kind == "anchor":
        shared = np.maximum.reduceat(doc, starts) != doc[starts]
        # The index need not answer those that are shared here; it only has to know that there is one.
        yield from _pack(bucket[starts], h=h[starts], doc=doc[starts], source=shared.astype(np.int64))
        known = np.flatnonzero(shared[group])
        if len(known):
            yield from _pack(buckets + _dealt(doc[known], buckets), h=h[known], doc=doc[known])
        return
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (tx[1:] != tx[:-1])
    asked = np.flatnonzero((doc == first) & fresh)
    yield from _pack(bucket[asked], h=h[asked], doc=doc[asked], tx=tx[asked], at=at[asked])
    known = np.flatnonzero(doc != first)
    if len(known):
        yield from _pack(buckets + _dealt(doc[known], buckets), doc=doc[known], tx=tx[known], at=at[known], source=first[known], source_at=at[starts][group][known])


def _scan(kind: str, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _send(kind, *(np.concatenate(x) for x in zip(*held)), buckets)

        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("tx").to_numpy()
            lists = batch.column("anchors").to_pylist() if kind == "block" else [None] * len(ids)
            for d, t, raw, known in zip(ids, hashes, texts(batch.column("text")), lists):
                words = word_hashes(raw, *word_bounds(raw, NOT_SPACE))
                if len(words) < window:
                    continue
                anchors = block_anchors(words, window)
                if kind == "anchor":
                    h = np.unique(anchors)
                    at, bucket = np.zeros(len(h), np.int32), h % np.uint64(buckets)
                else:
                    at = np.flatnonzero(np.isin(anchors, np.frombuffer(b"".join(known), np.uint64)))
                    h, first = np.unique(block_hashes(words, window)[at], return_index=True)
                    at = at[first].astype(np.int32)
                    # An independent hash deals out the blocks: two blocks are taken for equal only if both hashes agree.
                    bucket = gram_hashes(words, window, seed=0x2545F4914F6CDD1D)[at] % np.uint64(buckets)
                held.append((h, np.full(len(h), d, np.int64), np.full(len(h), t, np.int64), at, bucket.astype(np.int32)))
                size += len(h)
                if size >= PACK:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


def _answers(kind: str, **columns: np.ndarray) -> pa.Table:
    """One row for each document of the bucket with what was found for it."""
    names = ["doc", "tx"] if kind == "block" else ["doc"]
    order = np.lexsort(tuple(columns[k] for k in (["at", "tx", "doc"] if kind == "block" else ["doc"])))
    columns = {k: x[order] for k, x in columns.items()}
    cut, ends = _groups([columns[k] for k in names])
    lists = ["at", "source", "source_at"] if kind == "block" else ["h"]
    return pa.table([*(pa.array(columns[k][cut]) for k in names), *(pa.array([_write(k, columns[k][i:j]) for i, j in zip(cut, ends)], pa.binary()) for k in lists)], names=["doc_id", *names[1:], *lists])


def _answer(kind: str, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        def column(name: str) -> np.ndarray:
            return np.concatenate([_read(name, x) for x in rows.column(name).to_pylist()])

        if rows.column("bucket")[0].as_py() >= buckets:
            return _answers(kind, **{k: column(k) for k in (["doc", "tx", "at", "source", "source_at"] if kind == "block" else ["doc", "h"])})
        h, doc = column("h"), column("doc")
        order, starts, group = _by_hash(h, doc)
        h, doc = h[order], doc[order]
        if kind == "anchor":
            known = column("source")[order]
            shared = (np.maximum.reduceat(doc, starts) != doc[starts]) | np.maximum.reduceat(known, starts).astype(bool)
            ask = np.flatnonzero(shared[group] & (known == 0))
            return _answers(kind, doc=doc[ask], h=h[ask])
        tx, at = column("tx")[order], column("at")[order]
        ask = np.flatnonzero(doc != doc[starts][group])
        return _answers(kind, doc=doc[ask], tx=tx[ask], at=at[ask], source=doc[starts][group][ask], source_at=at[starts][group][ask])

    return run


def _factors(where: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> list[dict]:
    """Greedy factors from the indexed blocks at ascending positions."""
    if not len(where):
        return []
    follows = (where[1:] == where[:-1] + 1) & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    cut = np.flatnonzero(np.concatenate(([True], ~follows)))
    ends = np.concatenate((cut[1:], [len(where)])) - 1
    return [{"start": int(where[i]), "n_words": int(where[j] - where[i]) + window, "source": int(source[i]), "source_start": int(place[i])} for i, j in zip(cut, ends)]


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, removed, kept, factors = [], [], [], []
            found, whole = batch.column("found").to_pylist(), batch.column("whole").to_pylist()
            for raw, known, first in zip(texts(batch.column("text")), found, whole):
                if raw is None or not known:
                    words = raw.tobytes().split() if raw is not None else []
                    if first is not None and len(words) >= window:
                        count.append(len(words)), removed.append(len(words)), kept.append(b"")
                        factors.append([{"start": 0, "n_words": len(words), "source": first, "source_start": 0}])
                        continue
                    count.append(len(words)), removed.append(0), kept.append(b" ".join(words)), factors.append([])
                    continue
                starts, ends = word_bounds(raw, NOT_SPACE)
                own, source, place = (np.concatenate([_read(k, x[k]) for x in known]) for k in ("at", "source", "source_at"))
                blocks = block_hashes(word_hashes(raw, starts, ends), window)
                # A block that comes several times in the document was asked for at its first place.
                order = np.lexsort((place, source, blocks[own]))
                h, source, place = blocks[own][order], source[order], place[order]
                at = np.minimum(np.searchsorted(h, blocks), len(h) - 1)
                where = np.flatnonzero(h[at] == blocks)
                parts = _factors(where, source[at[where]], place[at[where]], window)
                gone = np.zeros(len(starts) + 1, np.int64)
                for f in parts:
                    gone[f["start"]] += 1
                    gone[f["start"] + f["n_words"]] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                data = raw.tobytes()
                count.append(len(starts)), removed.append(int((~stay).sum())), factors.append(parts)
                kept.append(b" ".join(data[i:j] for i, j in zip(starts[stay].tolist(), ends[stay].tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(count, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(factors, pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "factors"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, factors) for every row.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D, unchanged. A word goes if a run of `window` words that covers
    it also starts in a document with a smaller id; runs are judged on the input. factors are the spans in words, each with the
    document and word where its source starts. Null and empty texts have no words. Rows with a null doc_id are nobody's source
    and lose nothing. Rows that share a doc_id are one document: none of them is the other's source. An empty table gives an
    empty result. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tx", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // BUCKET_BYTES)
    usable = docs.where("doc_id is not null and text is not null")

    anchors = usable.mapInArrow(_scan("anchor", window, buckets), PACKED).groupBy("bucket").applyInArrow(_answer("anchor", buckets), FOUND["anchor"])
    repeated = anchors.groupBy("doc_id").agg(F.collect_list("h").alias("anchors"))
    # A whole text that a smaller document has too is one factor; it is nobody's first source, and its blocks stay out.
    named = usable.select("doc_id", "tx", F.octet_length("text").alias("size"), F.hash("text").alias("h"))
    same = ["tx", "size", "h"]
    firsts = named.groupBy(*same).agg(F.min("doc_id").alias("whole"), F.count("*").alias("n")).where("n > 1").select(*same, "whole")
    copies = named.join(firsts, same).where("whole < doc_id").select("doc_id", "tx", "whole").distinct()
    # Written between the exchanges, so that the files of one can go before the next begins.
    wanted = stored(named.select("doc_id", "tx").distinct().join(copies, ["doc_id", "tx"], "left_anti").join(repeated, "doc_id"), "anchors")
    blocks = usable.join(wanted, ["doc_id", "tx"]).mapInArrow(_scan("block", window, buckets), PACKED).groupBy("bucket").applyInArrow(_answer("block", buckets), FOUND["block"])
    answered = blocks.select("doc_id", "tx", F.struct("at", "source", "source_at").alias("part"), F.lit(None).cast("long").alias("whole"))
    answered = answered.unionByName(copies.withColumn("part", F.lit(None).cast(answered.schema["part"].dataType)))
    found = stored(answered.groupBy("doc_id", "tx").agg(F.collect_list("part").alias("found"), F.min("whole").alias("whole")), "factors")
    return docs.join(found, ["doc_id", "tx"], "left").select("doc_id", "text", "found", "whole").mapInArrow(_parse(window), f"doc_id long, n_words long, n_removed long, kept_text string, factors {FACTOR}")
