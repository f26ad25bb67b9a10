"""Boilerplate lines by a log-template tree, with DataFrame functions only.

A line is cut into tokens; a token with a digit is a variable. The tree has a fixed depth: the number of tokens, then the leading
tokens. Within a leaf a token stays in the template at its position if enough lines have it there, and is generalised otherwise,
so a field with many values becomes a variable whatever it holds. A template that keeps enough of its tokens and recurs in enough
documents is boilerplate: its lines go, but for those of the document with the smallest id that has one, where they are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

LEADING, MIN_DOCS, MIN_FIXED = 3, 6, 0.7
VARIABLE = "<*>"


def masked_lines(lines: Column) -> Column:
    """Each line's tokens joined by one space, those with a digit generalised; white space alone gives the empty string."""
    # Two passes, so that the spaces of a line are put in order once.
    flat = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\x0B\x0C]+", " ")))
    return F.transform(flat, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "(^| )[^ 0-9]*[0-9][^ ]*", f"$1{VARIABLE}")).otherwise(x))


def _named(masked: Column) -> list[Column]:
    """Two hashes, of 64 and of 32 bits, that stand for a line or a template, so that its text is moved once at most."""
    return [F.xxhash64(masked).alias("h"), F.hash(masked).alias("g")]


def _variables(masked: Column) -> Column:
    return F.when(F.contains(masked, F.lit(VARIABLE)), F.size(F.filter(F.split(masked, " "), lambda t: t == VARIABLE))).otherwise(0)


def _unit(own: str) -> Column:
    """What counts once for a template: a document, or its group of copies where it has one."""
    document = F.xxhash64("doc", "tx")
    return document if own == "doc" else F.when(F.col(own).isNull(), document).otherwise(F.xxhash64(own))


def line_table(docs: DataFrame, leading: int = LEADING, doc_id: str = "doc_id", text: str = "text", copies: DataFrame | None = None) -> DataFrame:
    """(doc, tx, pos, h, g, leaf, size, variables) for every line that is not blank, written once: all counts start here.

    With copies (doc, own) there is own too: the id that stands for the document's group, its own where copies has none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("tx"), F.split(F.col(text).cast("string"), "\n").alias("lines"))
    keys = ["doc", "tx"]
    if copies is not None:
        rows = rows.join(copies.select("doc", F.col("own").alias("_own")).hint("merge"), "doc", "left").withColumn("own", F.coalesce("_own", "doc"))
        keys = [*keys, "own"]
    spread = rows.where("lines is not null").select(*keys, F.posexplode(masked_lines(F.col("lines"))).alias("pos", "masked")).where("masked <> ''")
    size = F.length("masked") - F.length(F.replace("masked", F.lit(" "))) + 1
    leaf = F.xxhash64(size, F.substring_index("masked", " ", leading))
    return stored(spread.select(*keys, "pos", *_named(F.col("masked")), leaf.alias("leaf"), size.alias("size"), _variables(F.col("masked")).alias("variables")), "lines")


def recurring_lines(lines: DataFrame, docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, g, first_doc): the lines of line_table() whose template recurs, and the smallest document or group of the template."""
    own = "own" if "own" in lines.columns else "doc"
    unit, shape = _unit(own), ("leaf", "size", "variables")
    once = lines.groupBy(*dict.fromkeys(["doc", "tx", own]), "h", "g").agg(F.min("pos").alias("pos"), *[F.min(c).alias(c) for c in shape])
    once = once.select("h", "g", unit.alias("unit"), F.col(own).alias("first_doc"), F.struct("doc", "tx", "pos").alias("at"), *shape)
    if own != "doc":
        once = once.groupBy("h", "g", "unit").agg(*[F.min(c).alias(c) for c in ("first_doc", "at", *shape)])
    kinds = once.groupBy("h", "g").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("first_doc", "at", *shape)])
    kinds = stored(kinds, "kinds")
    leaves = kinds.groupBy("leaf").agg(F.sum("n").alias("docs"), F.count("*").alias("kinds")).where(F.col("docs") >= min_docs)
    known = stored(kinds.join(leaves.select("leaf", "kinds"), "leaf"), "known")
    # A line that comes often enough as it is has often enough each of its tokens: it is its own template.
    often = known.where(F.col("n") >= min_docs).select("h", "g", F.col("h").alias("th"), F.col("g").alias("tg"), "n", "first_doc", "size", "variables", F.lit(None).cast("array<bigint>").alias("units"))

    # Other leaves need the count of each token at each position. One document lends the words of each kind of line.
    several = known.where("kinds > 1").select(F.col("at.doc").alias("_doc"), F.col("at.tx").alias("_tx"), F.col("at.pos").alias("_pos"), "h", "g", "leaf", "n", "first_doc", "size")
    spread = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("tx"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("pos", "line"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tx") == F.col("_tx")) & (F.col("pos") == F.col("_pos"))
    # These sides grow with the corpus: the joins with the text sort and merge at every size, and nothing is broadcast.
    words = spread.join(several.hint("merge"), same).dropDuplicates(["h", "g"]).select("h", "g", "leaf", "n", "first_doc", "size", F.element_at(masked_lines(F.array("line")), 1).alias("masked"))
    # A document with several kinds of a leaf's lines supports it once, so the documents of each rare kind go along: fewer than min_docs.
    rare = stored(lines.select("h", "g", unit.alias("unit")).join(several.where(F.col("n") < min_docs).select("h", "g").hint("merge"), ["h", "g"]), "rare")
    units = rare.distinct().groupBy("h", "g").agg(F.collect_list("unit").alias("units"))
    words = words.withColumn("tokens", F.split("masked", " ")).drop("masked").join(units.hint("merge"), ["h", "g"], "left")
    words = stored(words, "words")
    # The leading tokens are the leaf's own and stay.
    tail = F.slice("tokens", leading + 1, F.greatest(F.size("tokens") - leading, F.lit(0)))
    placed = words.select("h", "g", "leaf", "n", "units", F.posexplode(tail).alias("pos", "token")).select("h", "g", "n", "units", "pos", F.xxhash64("leaf", "pos", "token").alias("k"))
    support = placed.where(F.col("n") < min_docs).select("k", F.explode_outer("units").alias("unit")).groupBy("k").agg(F.count_distinct("unit").alias("support"))
    frequent = placed.where(F.col("n") >= min_docs).select("k").union(support.where(F.col("support") >= min_docs).select("k")).distinct().withColumn("fixed", F.lit(True))
    # One group for each rare kind of line: as many flags as it has tokens.
    flags = placed.where(F.col("n") < min_docs).select("h", "g", "pos", "k").join(frequent, "k", "left").groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", F.lit(False)).alias("fixed")))).alias("flags"))
    shaped = words.where(F.col("n") < min_docs).join(flags, ["h", "g"]).select("h", "g", "n", "units", "first_doc", "size", F.concat(F.slice("tokens", 1, leading), F.zip_with(tail, "flags", lambda t, f: F.when(f["fixed"], t).otherwise(VARIABLE))).alias("parts"))
    shaped = shaped.withColumns({"template": F.array_join("parts", " "), "variables": F.size(F.filter("parts", lambda t: t == VARIABLE))})
    general = shaped.select("h", "g", *[c.alias(n) for c, n in zip(_named(F.col("template")), ("th", "tg"))], "n", "first_doc", "size", "variables", "units")
    every = stored(often.unionByName(general), "templates")
    recurring = every.withColumn("unit", F.explode_outer("units")).groupBy("th", "tg").agg(F.max("n").alias("n"), F.count_distinct("unit").alias("units"), F.min("first_doc").alias("first"), F.min("size").alias("size"), F.min("variables").alias("variables"))
    recurring = recurring.where((F.greatest("n", "units") >= min_docs) & (F.col("size") - F.col("variables") >= min_fixed * F.col("size")))
    return every.select("h", "g", "th", "tg").join(recurring.select("th", "tg", F.col("first").alias("first_doc")), ["th", "tg"]).select("h", "g", "first_doc")


def dropped_lines(docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, doc_id: str = "doc_id", text: str = "text", copies: DataFrame | None = None) -> DataFrame:
    """(doc, tx, lines): for each document that loses lines the ascending positions of these, from 0; tx is the hash of its text."""
    lines = line_table(docs, leading, doc_id, text, copies)
    own = F.col("doc" if copies is None else "own")
    recurring = recurring_lines(lines, docs, leading, min_docs, min_fixed, doc_id, text)
    gone = lines.join(recurring, ["h", "g"]).where(own.isNull() | F.col("first_doc").isNull() | (own != F.col("first_doc")))
    return stored(gone.groupBy("doc", "tx").agg(F.array_sort(F.collect_set("pos")).alias("lines")), "dropped")


def drop_templates(docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, doc_id: str = "doc_id", text: str = "text", name: str = "n_dropped", copies: DataFrame | None = None) -> DataFrame:
    """docs with the lines of recurring templates cut out of the text, and their number after the other columns.

    Every row stays, with its other columns as they are. Blank lines stay. Null texts stay null; empty ones stay empty. Rows
    that share id and text count as one document. A row without an id counts, and is never the one
    where a template is kept; if no document of a template has an id, all its lines go. Tied ids keep the template together. A
    column of the number's name that was there is replaced. An empty table gives an empty result.

    copies (doc, own) names documents that are copies, each with the smallest id of its group. A group counts as one document,
    and all of the smallest one keep a template, so copies stay alike.
    """
    gone = dropped_lines(docs, leading, min_docs, min_fixed, doc_id, text, copies).select(F.col("doc").alias("_cut_doc"), F.col("tx").alias("_cut_tx"), F.col("lines").alias("_cut"))
    docs = docs.drop(name).withColumns({"_own_doc": F.col(doc_id).cast("long"), "_own_tx": F.xxhash64(F.col(text).cast("string"))})
    out = docs.join(gone.hint("merge"), F.col("_own_doc").eqNullSafe(F.col("_cut_doc")) & (F.col("_own_tx") == F.col("_cut_tx")), "left")
    # The stretches between dropped lines, so that the work follows the number of lines.
    pieces = F.split(F.col(text), "\n")
    edges = F.concat(F.array(F.lit(-1)), F.col("_cut"), F.array(F.size(pieces)))
    stretches = F.transform(F.sequence(F.lit(1), F.size("_cut") + 1), lambda k: F.slice(pieces, F.element_at(edges, k) + 2, F.element_at(edges, k + 1) - F.element_at(edges, k) - 1))
    kept = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(stretches), "\n"))
    dropped = F.when(F.col("_cut").isNull(), 0).otherwise(F.size("_cut"))
    return out.withColumns({text: kept, name: dropped}).drop("_own_doc", "_own_tx", "_cut_doc", "_cut_tx", "_cut")
