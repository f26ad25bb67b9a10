"""Groups of near-copies by sketches of their words, with DataFrame functions only.

A document's shingles of five words fall by their hash into bins, and the least hash of each bin is its sketch: two documents agree
in a bin about as often as their sets of shingles overlap. Documents that share a band of bins are compared, by all bins, with the
one of the smallest id in that band, so the work follows documents and bands, and no band's documents are paired with each other.
The groups are estimates for counting copies once; operators that remove documents confirm them on full sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, stored

BINS, BAND, WORDS = 16, 2, 5
#: Least share of the bins in use that agree. For a similarity of 0.8 fewer agree in one of 500 pairs.
AGREE = 0.5


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tx, bins) for every document with words and an id; tx is the hash of its text, an unused bin is null."""
    words = F.filter(F.split(F.col(text).cast("string"), r"[ \t-\r]+"), lambda w: w != "")
    # Fewer words than a shingle are one.
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1)))
    # Bound by one variable, so that the words are cut once.
    shingles = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(places(w), lambda k: F.xxhash64(F.slice(w, k, WORDS)))))[0]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("tx"), F.explode_outer(shingles).alias("h")).where("doc is not null and h is not null")
    low = [F.min(F.when(F.pmod("h", F.lit(BINS)) == k, F.col("h"))).alias(f"b{k}") for k in range(BINS)]
    return rows.groupBy("doc", "tx").agg(*low).select("doc", "tx", F.array(*[f"b{k}" for k in range(BINS)]).alias("bins"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, own) for the documents that are in a group with a smaller id: its smallest id. Written once.

    Documents without an id, without words or without a copy have no row. An id with several texts joins the groups of all of them.
    Long texts are read whole; repeated rows are one. An empty table gives no rows. Other columns are not read.
    """
    made = stored(sketches(docs, doc_id, text), "sketches")
    bands = F.array(*[F.when(F.coalesce(*[F.col("bins")[k + j] for j in range(BAND)]).isNotNull(), F.xxhash64(F.lit(k), *[F.col("bins")[k + j] for j in range(BAND)])) for k in range(0, BINS, BAND)])
    placed = stored(made.select("doc", "tx", F.explode_outer(bands).alias("band")).where("band is not null"), "bands")
    me = F.struct("doc", "tx")
    first = placed.groupBy("band").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first < last").select("band", "first")
    pairs = placed.join(first.hint("merge"), "band").where(me != F.col("first")).select("doc", "tx", F.col("first.doc").alias("to"), F.col("first.tx").alias("to_tx")).distinct()
    theirs = made.select(F.col("doc").alias("to"), F.col("tx").alias("to_tx"), F.col("bins").alias("theirs"))
    both = pairs.join(made.hint("merge"), ["doc", "tx"]).join(theirs.hint("merge"), ["to", "to_tx"])
    same = F.size(F.filter(F.zip_with("bins", "theirs", lambda a, b: a == b), lambda x: x))
    used = F.size(F.filter(F.zip_with("bins", "theirs", lambda a, b: F.coalesce(a, b)), lambda x: x.isNotNull()))
    alike = both.where((same >= AGREE * used) & (F.col("doc") != F.col("to"))).select(F.col("doc").alias("a"), F.col("to").alias("b"))
    return components(alike, "copies", shrink=False).where("vertex <> component").select(F.col("vertex").alias("doc"), F.col("component").alias("own"))
