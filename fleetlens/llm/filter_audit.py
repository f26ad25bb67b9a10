"""How filters interact: what every order of five filters removes at each of its steps, without running any order.

A document matters only by the set of filters that it fails. In an order, a set is removed at the first of its filters, so the
orders that remove it at one step after one beginning are an interval of lexicographic (Lehmer) ranks. Each set adds its count where
such an interval begins and takes it off where it ends; prefix sums over the 120 ranks then give every order's numbers at once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

FILTERS = "ABCDE"
ORDERS = math.factorial(len(FILTERS))
#: Fixed by the contract: least words, least percent of distinct words, most percent of capitals, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, r"[#$%&*|]"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (A is 1); a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    # The bounds are filled in by one struct, so that the words are cut once.
    held = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    few = F.transform(F.array(held), lambda h: bit(h["n"] < WORDS, 0) + bit(100 * h["kinds"] < DISTINCT * h["n"], 1))[0]
    return few + bit(100 * capitals.cast("long") > CAPITALS * F.length(text).cast("long"), 2) + bit(text.rlike(MARKS), 3)


def patterns(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of each part fail exactly each set of filters.

    A text is told by its SHA-256. Filter E asks for the smallest id of each text: rows are first counted by (text, part, labels)
    with the smallest id in that group, so copies shrink before they meet, and no text's copies are gathered.
    """
    number, key = F.col(doc_id).cast("long"), F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    rows = docs.select(number.alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), key.alias("key"), failures(F.col(text)).alias("mask"))
    # Equal rows shrink to one before the join, so a repeated id is not a hot key.
    rows = rows.groupBy("doc", "part", "key", "mask").agg(F.count("*").alias("n"))
    marks = labels.select(F.col(doc_id).cast("long").alias("_doc"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("_doc is not null")
    marks = marks.groupBy("_doc").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.join(marks.hint("merge"), F.col("doc") == F.col("_doc"), "left").select("doc", "part", "key", "mask", "n", zero("good"), zero("toxic"))
    rows = rows.groupBy("doc", "part", "key", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    # Within a group an id has one row, so the smallest pair has the smallest id and how often it comes.
    named = F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))
    kinds = stored(rows.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(named).alias("low"), F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("nameless")), "kinds")
    first = kinds.groupBy("key").agg(F.min("low.doc").alias("first"))
    # Rows that hold the text's smallest id, or none, do not repeat an earlier document.
    kinds = kinds.join(first.hint("merge"), "key").withColumn("fresh", F.col("nameless") + F.when(F.col("low.doc") == F.col("first"), F.col("low.n")).otherwise(0))
    sides = F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("docs")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("docs")))
    split = kinds.select("part", "good", "toxic", F.explode(sides).alias("s")).select("part", "s.mask", "s.docs", "good", "toxic").where("docs > 0")
    return split.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic"))


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, sign): where each set of failures begins (1) and ceases (-1) to be removed at that step."""
    out = []
    for step in range(1, len(FILTERS) + 1):
        for beginning in itertools.permutations(range(len(FILTERS)), step):
            # The Lehmer code of the beginning is the rank of the first order that has it.
            rank = sum(sum(y < x for y in range(len(FILTERS)) if y not in beginning[:k]) * math.factorial(len(FILTERS) - 1 - k) for k, x in enumerate(beginning))
            span = math.factorial(len(FILTERS) - step)
            before = sum(1 << x for x in beginning[:-1])
            for mask in range(1, 1 << len(FILTERS)):
                if mask >> beginning[-1] & 1 and not mask & before:
                    out += [(mask, step, rank, 1), (mask, step, rank + span, -1)]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """600 rows for each part of patterns(): every order of the filters and every step of it.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included. A part
    costs at most 32 sets, 600 sums and 600 rows, whatever the number of its documents; parts are spread over tasks.
    """
    spark = counts.sparkSession
    values = ["docs", "good", "toxic"]
    # Fixed tables: their sizes follow the number of filters alone.
    places = spark.createDataFrame(intervals(), "mask int, step int, rank int, sign int")
    orders = [(k, "".join(o), step, o[step - 1], FILTERS.index(o[step - 1])) for k, o in enumerate(itertools.permutations(FILTERS)) for step in range(1, len(FILTERS) + 1)]
    steps = spark.createDataFrame(orders, "rank int, filter_order string, step int, letter string, bit int")
    changes = counts.join(F.broadcast(places), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(v) * F.col("sign")).alias(v) for v in values])
    letters = F.array(*[F.struct(F.lit(k).alias("bit"), F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("docs")).otherwise(0).alias("fails"), F.when(F.col("mask") == 1 << k, F.col("docs")).otherwise(0).alias("only")) for k in range(len(FILTERS))])
    totals = counts.select("part", "docs", F.explode(letters).alias("l")).groupBy("part", "l.bit").agg(F.sum("docs").alias("all"), F.sum("l.fails").alias("fails"), F.sum("l.only").alias("only"))
    grid = totals.join(F.broadcast(steps), "bit").join(changes, ["part", "step", "rank"], "left")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = grid.select("part", "filter_order", "step", "letter", "rank", "all", "fails", "only", *[F.sum(F.coalesce(v, F.lit(0))).over(along).alias(v) for v in values])
    down = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("part", "letter")
    long = lambda c, name: c.cast("long").alias(name)
    return sums.select(
        "part",
        "filter_order",
        "step",
        long(F.col("all") - F.sum("docs").over(down), "kept"),
        long(F.col("docs"), "removed"),
        long(F.col("fails") - F.col("docs"), "redundant"),
        long(F.col("only"), "unique_fails"),
        long(F.col("good"), "good_lost"),
        long(F.col("toxic"), "toxic_lost"),
        long(F.sum("docs").over(every), "shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every order and step of the filters, for each part of the documents.

    Null texts count as empty, and so equal empty ones; a null part is the empty string. Long texts are read whole. Rows that share
    id and text are one document more each, and do not repeat one another: only a smaller id makes a copy. A row without an id is
    neither a copy nor an original, and has no labels. Of several labels of one id, one that says 1 counts. Extra columns are not
    read. An empty table gives an empty result.
    """
    counts = stored(patterns(docs, labels, part, doc_id, text), "patterns")
    return audit(counts)
