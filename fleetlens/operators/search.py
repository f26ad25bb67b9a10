"""Ranked full-text search, per scope, with BM25 (k1 = 1.2, b = 0.75, idf floored at a small positive value)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import glob_match, is_binary, tokens
from fleetlens.operators.corpus import walk_order
from fleetlens.operators.ordered import top_k, unpack
from fleetlens.session import written

K1 = 1.2
B = 0.75
MIN_IDF = 1e-6

# How many results and targets there are where none is asked for.
DEFAULT_LIMIT = 20
FEDERATED_DEFAULT_LIMIT = 50
MAX_FANOUT_TARGETS = 64
MAX_QUERY_PAGE = 512
# Vectors of a block, and blocks whose best rows are merged before all are.
VECTOR_BLOCK = 1 << 16
MERGED_BLOCKS = 256


class Index(NamedTuple):
    """postings: scope, path, term, tf, dl; corpus: scope, n_docs, avgdl; buckets: of the terms of a stored index;
    sized: scope, path, dl, tokens of the documents, where the index is not stored."""

    postings: DataFrame
    corpus: DataFrame
    buckets: int | None = None
    sized: DataFrame | None = None

    def of_terms(self, terms: Sequence[str]) -> DataFrame:
        """Postings of exact terms; a stored index is read in the partitions of their buckets only."""
        found = self.postings.filter(F.col("term").isin(*terms))
        if self.buckets is None:
            return found
        return found.filter(F.col("bucket").isin(*[term_bucket(F.lit(t), self.buckets) for t in terms]))


def indexable(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    within = docs if max_bytes is None else docs.filter(F.octet_length("content") <= max_bytes)
    return within.filter(~is_binary(F.col("content")))


def index_skips(docs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per scope how many documents an index leaves out because they are binary or too large."""
    large = F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes
    return docs.groupBy("scope").agg(
        F.count_if(large).alias("too_large"), F.count_if(~large & is_binary(F.col("content"))).alias("binary")
    )


def word_counts(words: Column) -> Column:
    """(term, tf) of each distinct word of an array: one sort, then the ends of its runs."""

    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == F.size(s)) | (F.get(s, k) != F.get(s, k - 1)))
        run = lambda e: lambda k, i: F.struct(
            F.get(s, k - 1).alias("term"), (k - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("long").alias("tf")
        )
        return F.transform(F.array(ends), lambda e: F.transform(e, run(e)))[0]

    # Bound by variables, so that nothing is sorted twice.
    return F.transform(F.array(F.sort_array(words)), lambda s: F.when(F.size(s) > 0, runs(s)))[0]


def build_index(docs: DataFrame, max_bytes: int | None = None) -> Index:
    """Postings with document lengths, and corpus statistics per scope.

    The words of a document are counted where it is, so postings are shuffled only if rows share a scope and a path,
    which is asked of these two columns first.
    """
    tokenized = indexable(docs, max_bytes).select("scope", "path", tokens(F.col("content")).alias("tokens"))
    sized = tokenized.withColumn("dl", F.size("tokens").cast("long"))
    counted = unpack(sized, ["scope", "path", "dl"], word_counts(F.col("tokens")), "w")
    postings = counted.select("scope", "path", "dl", "w.term", "w.tf")
    if not docs.groupBy("scope", "path").count().filter("count > 1").isEmpty():
        postings = postings.groupBy("scope", "path", "dl", "term").agg(F.sum("tf").alias("tf"))
    corpus = sized.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Index(postings, corpus, sized=sized)


def write_index(index: Index, folder: str, buckets: int = 64) -> None:
    """Store postings partitioned by a hash of the term, so a query reads only its terms' buckets."""
    bucketed = index.postings.withColumn("bucket", term_bucket(F.col("term"), buckets))
    # Ranges split the bucket of a very common term by its documents.
    dealt = bucketed.repartitionByRange("bucket", "term", "scope", "path")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    index.corpus.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/corpus")


def read_index(spark, folder: str) -> Index:
    corpus = spark.read.parquet(f"{folder}/corpus")
    return Index(spark.read.parquet(f"{folder}/postings"), corpus.drop("buckets"), corpus.agg(F.max("buckets")).first()[0])


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index_diff(new: DataFrame, old: DataFrame, listing_truncated: bool = False) -> DataFrame:
    """added / updated / removed / unchanged per path, by ``version`` (mtime or content hash).

    Nothing counts as removed when the new listing was cut short.
    """
    now = new.select("scope", "path", F.col("version").alias("new_version"))
    then = old.select("scope", "path", F.col("version").alias("old_version"))
    change = (
        F.when(F.col("old_version").isNull(), "added")
        .when(F.col("new_version").isNull(), "unchanged" if listing_truncated else "removed")
        .when(F.col("new_version") == F.col("old_version"), "unchanged")
        .otherwise("updated")
    )
    return now.join(then, ["scope", "path"], "full").select("scope", "path", change.alias("change"))


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column) -> Column:
    idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search(
    index: Index,
    terms: Sequence[str],
    mode: str = "all",
    not_terms: Sequence[str] = (),
    prefix: bool = False,
    limit: int | None = DEFAULT_LIMIT,
) -> DataFrame:
    """Documents ranked by BM25 within their scope's corpus.  ``limit=None`` returns every hit.

    Terms are cut into words as texts are, so case and repetition do not matter and ``foo-bar`` asks for both words.
    """
    wanted = _words_of(terms)
    if not wanted:
        raise ValueError("search needs at least one term")
    unwanted = _words_of(not_terms)
    if index.sized is not None:
        near, corpus, banned = _found(index.sized, wanted, unwanted, prefix)
    else:
        corpus, banned = index.corpus, index.of_terms(unwanted)
        if prefix:
            query = F.array(*[F.lit(t) for t in wanted])
            near = index.postings.withColumn("q", F.explode(F.filter(query, lambda t: F.startswith("term", t))))
        else:
            near = index.of_terms(wanted).withColumn("q", F.col("term"))
    per_doc = near.groupBy("scope", "path", "dl", "q").agg(F.sum("tf").alias("tf"))
    allowed = per_doc.join(banned.select("scope", "path").distinct(), ["scope", "path"], "left_anti") if unwanted else per_doc
    doc_freq = per_doc.groupBy("scope", "q").agg(F.count("*").alias("df"))
    stats = doc_freq.join(corpus, "scope")
    scored = allowed.join(stats, ["scope", "q"]).withColumn(
        "s", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl"))
    )
    hits = scored.groupBy("scope", "path").agg(F.sum("s").alias("score"), F.count("*").alias("matched"))
    if mode == "all":
        hits = hits.filter(F.col("matched") == len(wanted))
    elif mode != "any":
        raise ValueError(f"unknown mode {mode!r}")
    hits = hits.select("scope", "path", "score")
    if limit is None:
        return hits
    return hits.orderBy(F.desc("score"), "scope", "path").limit(limit)


def _found(sized: DataFrame, wanted: list[str], unwanted: list[str], prefix: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the wanted words, corpus statistics and documents with an unwanted word, from one pass over the texts.

    The pass leaves one narrow row a document; all that is ranked reads those.
    """
    fits = (lambda w, t: F.startswith(w, F.lit(t))) if prefix else (lambda w, t: w == t)
    kept = F.filter("tokens", lambda w: reduce(or_, [fits(w, t) for t in wanted] + [w == t for t in unwanted]))
    some = sized.select("scope", "path", "dl", kept.alias("some"))
    count = lambda t: F.size(F.filter("some", lambda w: fits(w, t))).cast("long")
    tfs = F.array(*[F.struct(F.lit(t).alias("q"), count(t).alias("tf")) for t in wanted])
    narrow = written(some.select("scope", "path", "dl", tfs.alias("tfs"), F.exists("some", lambda w: w.isin(*unwanted)).alias("banned")), "found")
    near = narrow.select("scope", "path", "dl", F.explode("tfs").alias("t")).select("scope", "path", "dl", "t.q", "t.tf").filter("tf > 0")
    corpus = narrow.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return near, corpus, narrow.filter("banned")


def search_phrase(docs: DataFrame, phrase: str, limit: int | None = DEFAULT_LIMIT, max_bytes: int | None = None) -> DataFrame:
    """Documents holding the words of ``phrase`` in a row, ranked by BM25 of the phrase."""
    words = split_words(phrase)
    if not words:
        raise ValueError("empty phrase")
    tokenized = indexable(docs, max_bytes).select("scope", "path", tokens(F.col("content")).alias("tokens"))
    sized = tokenized.withColumn("dl", F.size("tokens").cast("long"))
    joined = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    # A look-ahead consumes nothing, so overlapping occurrences are all counted.
    occurrences = F.regexp_count(joined, F.lit(f"(?= {' '.join(words)} )"))
    counted = written(sized.select("scope", "path", "dl", occurrences.alias("tf")), "phrase")
    stats = counted.groupBy("scope").agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.count_if(F.col("tf") > 0).alias("df")
    )
    hits = counted.filter(F.col("tf") > 0).join(stats, "scope")
    score = bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl"))
    out = hits.select("scope", "path", F.col("tf").cast("long").alias("occurrences"), score.alias("score"))
    if limit is None:
        return out
    return out.orderBy(F.desc("score"), "scope", "path").limit(limit)


def _words_of(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(w for t in terms for w in split_words(t)))


def split_words(text: str) -> list[str]:
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def snippet(hits: DataFrame, terms: Sequence[str], width: int = 12) -> DataFrame:
    """``width`` words around the first match, matches in brackets, ellipses where text was cut.

    ``hits`` carries a ``content`` column.
    """
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    prepared = hits.withColumn("__words", words).withColumn(
        "__hit", F.transform(bare, lambda w: F.array_contains(wanted, w))
    )
    first = F.array_position("__hit", True).cast("int")
    start = F.greatest(F.lit(1), F.least(first - width // 3, F.size("__words") - width + 1))
    placed = prepared.withColumn("__start", start)
    shown = F.transform(
        F.arrays_zip(
            F.slice("__words", F.col("__start"), width).alias("w"), F.slice("__hit", F.col("__start"), width).alias("h")
        ),
        lambda p: F.when(p["h"], F.concat(F.lit("["), p["w"], F.lit("]"))).otherwise(p["w"]),
    )
    text = F.concat(
        F.when(F.col("__start") > 1, "… ").otherwise(""),
        F.array_join(shown, " "),
        F.when(F.col("__start") + width <= F.size("__words"), " …").otherwise(""),
    )
    return placed.withColumn("snippet", text).drop("__words", "__hit", "__start", "content")


def federated_search(hits: DataFrame, limit: int | None = FEDERATED_DEFAULT_LIMIT) -> DataFrame:
    """The best hits over all scopes.  ``hits``: node_id, scope, path, score.

    Each scope is cut to ``limit`` first, on the map side, so the global sort sees limit x scopes rows at most.
    ``limit=None`` returns them all.
    """
    if limit is None:
        return hits
    ordering = [F.desc("score"), F.asc("path")]
    local = top_k(hits, ["node_id", "scope"], ordering, limit).drop("rank")
    return local.orderBy(F.desc("score"), "node_id", "scope", "path").limit(limit)


def federated_grep(matches: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` matches of every (node, scope) in walk order, each with its origin."""
    return top_k(matches, ["node_id", "scope"], walk_order(), limit, rank="match_no")


def with_provenance(results: DataFrame, targets: DataFrame, answers: DataFrame) -> DataFrame:
    """A fan-out's results, the scopes that failed, and one row that counts both.

    ``results``: node_id, scope and what was found there.  ``targets``: the pairs that were asked, as ``fanout_pairs``
    gives them.  ``answers``: node_id, scope, error - null where the scope answered; of several answers of a pair an
    error holds, the first by name.  A pair without an answer failed as ``no answer``.

    Rows of kind ``result`` keep their columns; results of pairs that failed, or were not asked, do not count.  Rows of
    kind ``failure`` say the error, the one of kind ``provenance`` has targets_ok, targets_failed and truncated_targets.
    """
    pair = ["node_id", "scope"]
    told = answers.groupBy(*pair).agg(F.min("error").alias("error"), F.lit(True).alias("told"))
    asked = targets.groupBy(*pair).agg(F.max("truncated_targets").alias("truncated"))
    judged = asked.join(told, pair, "left").select(*pair, F.when(F.col("told"), F.col("error")).otherwise("no answer").alias("error"), "truncated")
    found = results.join(judged.filter(F.col("error").isNull()).select(*pair), pair, "left_semi")
    failed = judged.filter(F.col("error").isNotNull()).select(F.lit("failure").alias("kind"), *pair, "error")
    counts = judged.agg(
        F.count_if(F.col("error").isNull()).alias("targets_ok"),
        F.count_if(F.col("error").isNotNull()).alias("targets_failed"),
        F.coalesce(F.max("truncated"), F.lit(0)).cast("long").alias("truncated_targets"),
    )
    rows = found.select(F.lit("result").alias("kind"), *results.columns).unionByName(failed, allowMissingColumns=True)
    return rows.unionByName(counts.withColumn("kind", F.lit("provenance")), allowMissingColumns=True)


def fanout_pairs(
    manifests: DataFrame, live: DataFrame, capability: str, self_node: str, cap: int | None = MAX_FANOUT_TARGETS
) -> DataFrame:
    """(node, scope) targets of a fan-out over live nodes that offer ``capability``, own node first, and how many
    pairs the cap left out."""
    able = manifests.filter(F.array_contains("capabilities", capability)).join(live.select("node_id"), "node_id", "left_semi")
    pairs = able.select("node_id", F.explode("scopes").alias("scope"))
    if cap is None:
        return pairs.withColumn("truncated_targets", F.lit(0).cast("long"))
    left_out = pairs.agg(F.greatest(F.count("*") - cap, F.lit(0))).scalar()
    first = pairs.orderBy((F.col("node_id") != self_node).cast("int"), "node_id", "scope").limit(cap)
    return first.withColumn("truncated_targets", left_out)


def find_file(docs: DataFrame, name_glob: str) -> DataFrame:
    """Files by name over all scopes, one row per distinct content with the first place it was found."""
    found = docs.filter(glob_match(F.col("path"), name_glob)).select(
        "scope", "path", F.sha2("content", 256).alias("content_hash")
    )
    copies = found.groupBy("content_hash").agg(
        F.min(F.struct("scope", "path")).alias("first"), F.count("*").alias("copies")
    )
    return copies.select("content_hash", F.col("first.scope").alias("scope"), F.col("first.path").alias("path"), "copies")


def embed_lookup(
    vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = MAX_QUERY_PAGE, vector_block: int = VECTOR_BLOCK
) -> DataFrame:
    """The ``k`` vectors most similar to each query by dot product (unit vectors: cosine), ties to the smaller vec_id.

    ``vectors``: vec_id, embedding.  ``queries``: query_id, embedding.  Both are dealt over a grid of blocks: a task
    holds about ``query_block`` queries, and multiplies them with the vectors of one block as these pass through,
    keeping k rows a query.  The k best of the blocks are merged by groups of blocks first, then over all.  Rows
    without a vector are left out.
    """
    whole = F.col("embedding").cast("array<double>").alias("embedding")
    there = F.col("embedding").isNotNull()
    rows_v, rows_q = vectors.filter(there).count(), queries.filter(there).count()
    across, down = max(1, -(-rows_v // vector_block)), max(1, -(-rows_q // query_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.filter(there).select(
        each(across).alias("i"), block("query_id", down).alias("j"), F.col("query_id").cast("string").alias("query_id"), F.lit(None).cast("long").alias("vec_id"), whole
    )
    known = vectors.filter(there).select(
        block("vec_id", across).alias("i"), each(down).alias("j"), F.lit(None).cast("string").alias("query_id"), F.col("vec_id").cast("long").alias("vec_id"), whole
    )
    grid = asked.unionByName(known).withColumn("known", F.col("query_id").isNull())
    dealt = grid.repartition(across * down, "i", "j").sortWithinPartitions("i", "j", "known")
    partial = dealt.mapInArrow(_nearest(k), "i int, query_id string, vec_id long, score double")
    ordering = [F.desc("score"), F.asc("vec_id")]
    merged = top_k(partial.withColumn("part", F.floor(F.col("i") / MERGED_BLOCKS)), ["query_id", "part"], ordering, k) if across > MERGED_BLOCKS else partial
    return top_k(merged.select("query_id", "vec_id", "score"), ["query_id"], ordering, k)


def _nearest(k: int):
    """Of rows sorted by block, queries first: the k best vectors of each block for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, matrix, ids, scores = None, [], [], None, None

        def best(new_ids: np.ndarray, new_scores: np.ndarray) -> None:
            nonlocal ids, scores
            new_ids = np.broadcast_to(new_ids, new_scores.shape)
            ids = new_ids if ids is None else np.concatenate([ids, new_ids], axis=1)
            scores = new_scores if scores is None else np.concatenate([scores, new_scores], axis=1)
            order = np.lexsort((ids, -scores), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)

        def done() -> Iterator[pa.RecordBatch]:
            if ids is not None:
                n = ids.shape[1]
                columns = [pa.array(np.full(len(names) * n, at[0]), pa.int32()), pa.array(np.repeat(np.array(names, object), n), pa.string()), pa.array(ids.ravel()), pa.array(scores.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["i", "query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            side = batch.column("known").to_numpy(zero_copy_only=False)
            change = (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (side[1:] != side[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if (i[lo], j[lo]) != at:
                    yield from done()
                    at, names, matrix, ids, scores = (i[lo], j[lo]), [], [], None, None
                rows = batch.slice(lo, hi - lo)
                block = np.array(rows.column("embedding").to_pylist(), np.float64)
                if not side[lo]:
                    names += rows.column("query_id").to_pylist()
                    matrix.append(block)
                elif names:
                    best(rows.column("vec_id").to_numpy()[None, :], np.concatenate(matrix) @ block.T)
        yield from done()

    return run
