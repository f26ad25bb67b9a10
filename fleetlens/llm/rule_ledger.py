"""Quality rules as a ledger: every rule is evaluated once for each document, and policies read the stored bits.

A ledger row holds a document's measurements and one bit for each rule that it fails. Policies are versioned sets of bits: those
that reject alone and those that reject together. They are applied, compared and ablated on the bits alone, so neither a new policy
nor a new question reads a text again; ablations are sums over the patterns of bits, of which there are 2^rules at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import NOT_SPACE, byte_set, gram_hashes, texts, word_bounds, word_hashes

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOLS = byte_set(b"#*$%&|<>")

#: The rules in the order of their bits: name and the condition on the measurements under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Rejects what fails one of the rules in `alone`, or at least `least` of those in `together`."""

    version: str
    alone: tuple[str, ...]
    together: tuple[str, ...] = ()
    least: int = 2

    def mask(self, of: tuple[str, ...]) -> int:
        return sum(BITS[x] for x in of)

    def rejects(self, failed: Column, without: int = 0) -> Column:
        """Whether the policy rejects these failure bits; the bits of `without` count as passed."""
        bits = failed.bitwiseAND(F.lit(~without).cast("long"))
        some = bits.bitwiseAND(F.lit(self.mask(self.alone)).cast("long")) != 0
        return some | (F.bit_count(bits.bitwiseAND(F.lit(self.mask(self.together)).cast("long"))) >= self.least)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = [BASE, Policy("v1", ("few_words", "repeated_words", "symbols"), ("short_words", "long_words", "repeated_lines"))]


def measure(raw: np.ndarray) -> tuple[int, ...]:
    """The measurements of one text; equal lines and equal windows are told by 64-bit hashes of their words."""
    starts, ends = word_bounds(raw, NOT_SPACE)
    n = len(starts)
    if not n:
        return (0,) * len(MEASURES)
    chars = int(np.count_nonzero(((raw & 0xC0) != 0x80) & NOT_SPACE[raw]))
    cut = np.flatnonzero(raw == 0x0A)
    begin, end = np.append(0, cut + 1), np.append(cut, len(raw))
    # A word never runs over a line's end, so a line holds one if a word starts in it.
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    lines = word_hashes(raw, begin[worded], end[worded])
    repeated = 0
    if n > WINDOW:
        order = np.argsort(grams := gram_hashes(word_hashes(raw, starts, ends), WINDOW), kind="stable")
        same = np.append(False, grams[order[1:]] == grams[order[:-1]])
        again = order[same | np.append(same[1:], False)]
        if len(again):
            turn = np.zeros(n + 1, np.int64)
            turn[again] += 1  # positions of windows are distinct
            turn[again + WINDOW] -= 1
            repeated = int(np.count_nonzero(np.cumsum(turn[:n])))
    return n, chars, int(np.count_nonzero(SYMBOLS[raw])), len(lines), len(lines) - len(np.unique(lines)), repeated


def _measured(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(0,) * len(MEASURES) if raw is None else measure(raw) for raw in texts(batch.column(text))]
            found = np.array(rows, np.int64).reshape(-1, len(MEASURES))
            for k, name in enumerate(MEASURES):
                batch = batch.append_column(name, pa.array(found[:, k]))
            yield batch

    return run


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed`, a long with one bit for each of RULES, after their own columns.

    Words are `[^\\x20\\x09-\\x0D]+`. n_repeat_words are words inside a window of 8 words that occurs twice or more in the text, the
    first time included; windows may overlap. n_dup_lines are lines with a word that equal an earlier line of the text.

    Map only: every row stays, repeated rows, ties and rows without an id as they are. Null, empty and blank texts measure 0
    throughout and fail few_words. A text is measured whole, however long. Columns of the ledger's names that were there are
    replaced; no other column is read. An empty table gives an empty ledger.
    """
    docs = docs.drop(*MEASURES, "failed")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in MEASURES]])
    bits = [F.when(F.expr(rule), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return docs.mapInArrow(_measured(text), schema).withColumn("failed", failed)


def apply_policies(rows: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """Ledger rows with `kept_<version>` for each policy; only the bits are read."""
    return rows.withColumns({f"kept_{p.version}": ~p.rejects(F.col("failed")) for p in policies})


def ablations(rows: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """One row for each policy and rule over the whole ledger: what the rule fails, and what it alone decides.

    (version, rule, used, n_docs, n_failed, n_rejected, n_decided, shared). n_rejected are the policy's rejections, n_decided those
    it would keep without the rule; shared has the bits that all documents decided by the rule fail (null if there are none).
    The ledger is aggregated by its bits once; all else works on patterns. An empty ledger gives a row of zeros for each pair.
    """
    spark = rows.sparkSession
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p, name) for p in policies for name, _ in RULES]
    named = spark.createDataFrame([(p.version, name, name in (*p.alone, *p.together), k) for k, (p, name) in enumerate(cases)], "version string, rule string, used boolean, at int")
    verdicts = F.array(*[F.struct(F.lit(k).alias("at"), (F.col("failed").bitwiseAND(F.lit(BITS[name]).cast("long")) != 0).alias("fails"), p.rejects(F.col("failed")).alias("out"), p.rejects(F.col("failed"), BITS[name]).alias("still")) for k, (p, name) in enumerate(cases)])
    each = patterns.select("failed", "n", F.explode(verdicts).alias("v")).select("failed", "n", "v.*")
    decided = F.col("out") & ~F.col("still")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    sums = each.groupBy("at").agg(F.sum("n").alias("n_docs"), count(F.col("fails"))("n_failed"), count(F.col("out"))("n_rejected"), count(decided)("n_decided"), F.bit_and(F.when(decided, F.col("failed"))).alias("shared"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return named.join(sums, "at", "left").select("version", "rule", "used", *[zero(c) for c in ("n_docs", "n_failed", "n_rejected", "n_decided")], "shared")
