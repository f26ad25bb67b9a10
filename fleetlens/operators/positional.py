"""A stored index with word positions that is kept up to date by segments.

A refresh tokenises only what changed and adds one segment: postings of the documents that are new or different, the
documents themselves, tombstones of those that left or changed, and what all this adds to each scope's statistics. No
earlier file is touched. A merge writes the live postings as one segment without reading a text. A segment counts once
its row in ``commits`` is written, so a job that dies half way leaves the index as it was and its number is used again.

Tables below the folder, all with a column ``segment``: ``postings`` (by ``bucket``, a hash of the term), ``documents``,
``removed``, ``changes`` and ``commits``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import is_binary, tokens
from fleetlens.operators.search import DEFAULT_LIMIT, Index, bm25, index_diff, indexable, split_words, term_bucket
from fleetlens.session import erase, written

KEY = ["scope", "path"]
POSTING = "scope string, path string, term string, tf long, dl long, positions array<int>, segment int, bucket int"
DOCUMENT = "scope string, path string, version string, dl long, segment int"
TOMBSTONE = "scope string, path string, segment int"
CHANGE = "scope string, n_docs long, words long, segment int"
COMMIT = "buckets int, base boolean, segment int"
#: Words that are grouped at once (or those of one document), and postings that leave Python at once.
WORDS, ROWS = 1 << 20, 1 << 15


class State(NamedTuple):
    """Segments from ``base`` to ``last`` are read (last -1: none); terms are dealt over ``buckets``."""

    base: int
    last: int
    buckets: int


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and distinct word with its positions, ascending from 0; as many documents at once as have WORDS words."""
    for batch in batches:
        words = batch.column("words")
        counts = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        until, at = np.cumsum(counts), 0
        while at < len(counts):
            end = max(at + 1, int(np.searchsorted(until, until[at] - counts[at] + WORDS, side="right")))
            n, docs = counts[at:end], batch.slice(at, end - at)
            coded = words.slice(at, end - at).flatten().dictionary_encode()
            at = end
            if not len(coded):
                continue
            code, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
            place = (np.arange(len(code)) - (np.cumsum(n) - n)[doc]).astype(np.int32)
            key = doc * len(coded.dictionary) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            bounds = np.append(first, len(order))
            of, term = pa.array(doc[order[first]]), coded.dictionary.take(pa.array(code[order[first]]))
            columns = [docs.column("scope").take(of), docs.column("path").take(of), term, pa.array(np.diff(bounds)), pa.array(n[of]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(place[order]))]
            rows = pa.RecordBatch.from_arrays(columns, [*KEY, "term", "tf", "dl", "positions"])
            for k in range(0, rows.num_rows, ROWS):
                yield rows.slice(k, ROWS)


def positional_postings(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(scope, path, term, tf, dl, positions) of every document; no shuffle, a document's words are grouped where it is."""
    cut = indexable(docs, max_bytes).select(*KEY, tokens(F.col("content")).alias("words"))
    return cut.mapInArrow(_grouped, "scope string, path string, term string, tf long, dl long, positions array<int>")


def _state(spark: SparkSession, folder: str, buckets: int) -> State:
    """What is committed. There is one row a refresh, and a merge starts anew."""
    if not _exists(spark, f"{folder}/commits"):
        return State(0, -1, buckets)
    rows = spark.read.schema(COMMIT).parquet(f"{folder}/commits")
    found = rows.agg(F.max(F.when(F.col("base"), F.col("segment"))), F.max("segment"), F.max("buckets")).first()
    return State(0, -1, buckets) if found[1] is None else State(*found)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _read(spark: SparkSession, folder: str, name: str, schema: str, state: State) -> DataFrame:
    if state.last < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}").filter(F.col("segment").between(state.base, state.last))


def _write(df: DataFrame, folder: str, name: str, segment: int, *parts: str) -> None:
    """One segment of one table. Positions ascend, so Parquet's delta encoding stores their differences."""
    writer = df.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#positions.list.element", "false")
    (writer.partitionBy(*parts) if parts else writer).parquet(f"{folder}/{name}/segment={segment}")


def _alive(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows whose document no later segment has removed or written anew."""
    last = removed.groupBy(*KEY).agg(F.max("segment").alias("_gone"))
    gone = (rows["scope"] == last["scope"]) & (rows["path"] == last["path"]) & (rows["segment"] < last["_gone"])
    return rows.join(last, gone, "left_anti")


def _write_postings(postings: DataFrame, folder: str, segment: int, buckets: int) -> None:
    # A bucket is dealt by its documents as well, so a very common term has many writers; within a file a term's postings lie
    # together. Ranges would be sampled first, which cuts every text into words once more.
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*KEY), F.lit(-(-4 * tasks // buckets)))
    dealt = postings.withColumns({"bucket": term_bucket(F.col("term"), buckets), "_part": part}).repartition("bucket", "_part").drop("_part")
    _write(dealt.sortWithinPartitions("bucket", "term", *KEY), folder, "postings", segment, "bucket")


def _commit(spark: SparkSession, folder: str, segment: int, buckets: int, base: bool) -> None:
    _write(spark.createDataFrame([(buckets, base)], "buckets int, base boolean").coalesce(1), folder, "commits", segment)


def refresh(docs: DataFrame, folder: str, buckets: int = 64, max_bytes: int | None = None, listing_truncated: bool = False) -> State:
    """Bring the index below ``folder`` to ``docs`` (scope, path, version, content); creates it where there is none.

    Only documents whose version is new are tokenised. Documents that are gone leave the index unless the listing was cut
    short. Binary documents and those above ``max_bytes`` are listed without words, and do not count in the statistics.
    A document is one (scope, path) of its greatest version; rows of equal version have equal texts.
    """
    spark = docs.sparkSession
    state = _state(spark, folder, buckets)
    segment = state.last + 1
    with_words = ~is_binary(F.col("content"))
    if max_bytes is not None:
        with_words &= F.octet_length("content") <= max_bytes
    # What is asked of all documents is asked once; their texts are read again only where they are new.
    listing = written(docs.groupBy(*KEY).agg(F.max("version").alias("version"), F.max_by(with_words, "version").alias("_words"), F.count("*").alias("_rows")), "listing")
    old = _alive(_read(spark, folder, "documents", DOCUMENT, state), _read(spark, folder, "removed", TOMBSTONE, state))
    change = index_diff(listing, old, listing_truncated)
    new = change.filter(F.col("change").isin("added", "updated")).select(*KEY).join(listing, KEY).filter("version is not null")
    wanted = written(new, "wanted")
    fresh = docs.dropna(subset=[*KEY, "version"])
    if state.last >= 0:
        fresh = fresh.join(wanted, [*KEY, "version"], "left_semi")
    if not wanted.filter("_rows > 1").isEmpty():
        fresh = docs.join(wanted, [*KEY, "version"], "left_semi").dropDuplicates(KEY)
    _write(change.filter(F.col("change").isin("removed", "updated")).select(*KEY), folder, "removed", segment)
    _write_postings(positional_postings(fresh, max_bytes), folder, segment, state.buckets)
    mine = State(segment, segment, state.buckets)
    # Lengths come from the postings just written: no text is cut into words twice.
    # One term of a document begins it, so its length is told once and no other posting is shuffled.
    sizes = _read(spark, folder, "postings", POSTING, mine).filter(F.col("positions")[0] == 0).select(*KEY, F.col("dl").alias("_dl"))
    listed = wanted.select(*KEY, F.col("version").cast("string").alias("version"), "_words").join(sizes, KEY, "left")
    _write(listed.select(*KEY, "version", F.when(F.col("_words"), F.coalesce("_dl", F.lit(0))).cast("long").alias("dl")), folder, "documents", segment)
    for done in (listing, wanted):
        erase(done)
    came = _read(spark, folder, "documents", DOCUMENT, mine).filter("dl is not null").select("scope", F.lit(1).alias("n"), "dl")
    gone = _read(spark, folder, "removed", TOMBSTONE, mine).select(*KEY)
    left = old.join(gone, KEY, "left_semi").filter("dl is not null").select("scope", F.lit(-1).alias("n"), (-F.col("dl")).alias("dl"))
    changes = came.unionByName(left).groupBy("scope").agg(F.sum("n").cast("long").alias("n_docs"), F.sum("dl").cast("long").alias("words"))
    _write(changes, folder, "changes", segment)
    _commit(spark, folder, segment, state.buckets, base=segment == 0)
    return State(state.base, segment, state.buckets)


def merge_segments(spark: SparkSession, folder: str) -> State:
    """One segment of all that is live; earlier ones are no longer read. Postings are copied, no text is tokenised."""
    state = _state(spark, folder, 0)
    if state.last < 0:
        raise ValueError(f"no index in {folder}")
    segment = state.last + 1
    removed = _read(spark, folder, "removed", TOMBSTONE, state)
    _write_postings(_alive(_read(spark, folder, "postings", POSTING, state), removed).drop("segment", "bucket"), folder, segment, state.buckets)
    _write(_alive(_read(spark, folder, "documents", DOCUMENT, state), removed).drop("segment"), folder, "documents", segment)
    _write(removed.filter(F.lit(False)).drop("segment"), folder, "removed", segment)
    changes = _read(spark, folder, "changes", CHANGE, state).groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
    _write(changes, folder, "changes", segment)
    _commit(spark, folder, segment, state.buckets, base=True)
    return State(segment, segment, state.buckets)


def open_index(spark: SparkSession, folder: str) -> Index:
    """The live index below ``folder``. A filter on exact terms and their buckets reaches the scan of the postings."""
    state = _state(spark, folder, 1)
    postings = _alive(_read(spark, folder, "postings", POSTING, state), _read(spark, folder, "removed", TOMBSTONE, state))
    totals = _read(spark, folder, "changes", CHANGE, state).groupBy("scope").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("words"))
    corpus = totals.filter("n_docs > 0").select("scope", "n_docs", (F.col("words") / F.col("n_docs")).alias("avgdl"))
    return Index(postings, corpus, state.buckets)


def search_phrase_index(index: Index, phrase: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Documents holding the words of ``phrase`` in a row, ranked by BM25 of the phrase; reads postings only.

    (scope, path, occurrences, score). A document's lists of its at most len(words) terms meet in one row, each shifted by
    the word's place in the phrase; where they intersect the phrase begins, so overlapping occurrences all count.
    """
    words = split_words(phrase)
    if not words:
        raise ValueError("empty phrase")
    wanted: Sequence[str] = list(dict.fromkeys(words))
    near = index.of_terms(wanted).select(*KEY, "dl", "term", "positions")
    # One row of a document and term is live, so a group has at most as many rows as the phrase has words.
    lists = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(wanted)]
    whole = near.groupBy(*KEY).agg(F.max("dl").alias("dl"), F.count("*").alias("n"), *lists).filter(F.col("n") == len(wanted))
    begin = lambda w, k: F.transform(f"p{wanted.index(w)}", lambda p: p - k)
    shifted = [begin(w, k) for k, w in enumerate(words)]
    counted = whole.select(*KEY, "dl", F.size(reduce(F.array_intersect, shifted)).cast("long").alias("tf")).filter("tf > 0")
    stats = counted.groupBy("scope").agg(F.count("*").alias("df")).join(index.corpus, "scope")
    score = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl"))
    hits = counted.join(stats, "scope").select(*KEY, F.col("tf").alias("occurrences"), score.alias("score"))
    return hits if limit is None else hits.orderBy(F.desc("score"), *KEY).limit(limit)
