"""Text corpora: listing, previewing and grepping files.

``docs``: scope, path, content (text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import glob_match, is_binary, quote_pattern, truncate_bytes
from fleetlens.operators.ordered import unpack

# How much of a file a preview shows, and of a line a match.
DEFAULT_PREVIEW_BYTES = 1024 * 1024
MAX_LINE_BYTES = 512


def list_inventory(
    docs: DataFrame, path: str = "", max_depth: int | None = 1, max_entries: int | None = None
) -> DataFrame:
    """Files and folders below ``path``, breadth first, with ``truncated`` telling whether entries were left out.

    ``docs``: path, size.  ``max_depth=None`` lists all levels, ``max_entries=None`` all entries.
    """
    if path:
        prefix = path.rstrip("/") + "/"
        docs = docs.filter(F.startswith("path", F.lit(prefix))).withColumn(
            "path", F.col("path").substr(F.lit(len(prefix) + 1), F.length("path"))
        )
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    split = docs.select(parts.alias("parts"), F.col("size").cast("long").alias("size"))
    deepest = F.size("parts") if max_depth is None else F.least(F.size("parts"), F.lit(max_depth))
    levels = split.filter(F.size("parts") > 0).select("parts", "size", F.explode(F.sequence(F.lit(1), deepest)).alias("depth"))
    entries = (
        levels.select(
            F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("entry"),
            "depth",
            (F.col("depth") == F.size("parts")).alias("is_file"),
            "size",
        )
        .groupBy("entry", "depth")
        .agg(
            F.when(F.max("is_file"), "file").otherwise("dir").alias("kind"),
            F.max(F.when(F.col("is_file"), F.col("size"))).alias("size_bytes"),
        )
    )
    if max_entries is None:
        return entries.withColumn("truncated", F.lit(False))
    cut = entries.agg(F.count("*") > max_entries).scalar()
    return entries.orderBy("depth", "entry").limit(max_entries).withColumn("truncated", cut)


def preview(docs: DataFrame, max_bytes: int = DEFAULT_PREVIEW_BYTES, encoding: str = "utf8") -> DataFrame:
    """The beginning of every file as text (cut on a character boundary) or base64, with its full size."""
    size = F.octet_length("content").cast("long")
    if encoding == "base64":
        shown = F.base64(F.substring(F.encode("content", "UTF-8"), 1, max_bytes))
        # base64() breaks long output into lines; the reader wants one string.
        shown = F.regexp_replace(shown, r"\s", "")
    elif encoding == "utf8":
        shown = truncate_bytes(F.col("content"), max_bytes)
    else:
        raise ValueError(f"unknown encoding {encoding!r}")
    return docs.select(
        "scope",
        "path",
        size.alias("size_bytes"),
        F.lit(encoding).alias("encoding"),
        shown.alias("content"),
        (size > max_bytes).alias("truncated"),
    )


def glob_filter(df: DataFrame, column: str, glob: str, ignore_case: bool = False) -> DataFrame:
    return df.filter(glob_match(F.col(column), glob, ignore_case))


def _scannable(docs: DataFrame, max_bytes: int | None) -> DataFrame:
    content = F.col("content")
    within = docs if max_bytes is None else docs.filter(F.octet_length(content) <= max_bytes)
    return within.filter(~is_binary(content))


def line_matcher(line: Column, pattern: str, literal: bool, ignore_case: bool) -> Column:
    if literal and not ignore_case:
        return F.contains(line, F.lit(pattern))
    body = quote_pattern(pattern) if literal else pattern
    return line.rlike(("(?iu)" if ignore_case else "") + body)


def walk_order() -> list[Column]:
    """Depth-first, name-sorted: comparing the path parts left to right."""
    return [F.split("path", "/"), F.col("line_number")]


def grep(
    docs: DataFrame,
    pattern: str,
    literal: bool = False,
    ignore_case: bool = False,
    file_glob: str | None = None,
    max_results: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Matching lines with 1-based numbers; a line is shown up to 512 bytes, cut on a character boundary.

    ``max_results`` holds over all scopes.  ``max_bytes`` leaves out larger files, which ``grep_stats`` counts.
    """
    if file_glob is not None:
        docs = glob_filter(docs, "path", file_glob)
    docs = _scannable(docs, max_bytes).filter(F.col("content") != "")
    if literal and not ignore_case and "\n" not in pattern:
        docs = docs.filter(F.contains("content", F.lit(pattern)))
    body = F.regexp_replace("content", r"\n\z", "")
    lines = unpack(docs, ["scope", "path"], F.split(body, "\n"), "pos", "raw")
    lines = lines.select(
        "scope", "path", (F.col("pos") + 1).alias("line_number"), F.regexp_replace("raw", r"\r\z", "").alias("full")
    )
    found = lines.filter(line_matcher(F.col("full"), pattern, literal, ignore_case)).select(
        "scope",
        "path",
        "line_number",
        truncate_bytes(F.col("full"), MAX_LINE_BYTES).alias("line"),
        (F.octet_length("full") > MAX_LINE_BYTES).alias("line_truncated"),
    )
    return found if max_results is None else found.orderBy(*walk_order()).limit(max_results)


def grep_stats(
    docs: DataFrame,
    pattern: str,
    literal: bool = False,
    ignore_case: bool = False,
    file_glob: str | None = None,
    max_results: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per scope: files scanned and skipped, matching lines, and whether ``max_results`` cuts them."""
    if file_glob is not None:
        docs = glob_filter(docs, "path", file_glob)
    content = F.col("content")
    large = F.lit(False) if max_bytes is None else F.octet_length(content) > max_bytes
    binary = ~large & is_binary(content)
    body = F.regexp_replace(content, r"\n\z", "")
    hits = F.size(
        F.filter(
            F.split(body, "\n"),
            lambda raw: line_matcher(F.regexp_replace(raw, r"\r\z", ""), pattern, literal, ignore_case),
        )
    )
    counted = docs.select(
        "scope",
        large.alias("large"),
        binary.alias("binary"),
        F.when(large | binary | (content == ""), 0).otherwise(hits).cast("long").alias("hits"),
    )
    totals = counted.groupBy("scope").agg(
        F.count_if(~F.col("large") & ~F.col("binary")).alias("files_scanned"),
        F.count_if("binary").alias("skipped_binary"),
        F.count_if("large").alias("skipped_too_large"),
        F.sum("hits").alias("matches"),
    )
    cut = F.lit(False) if max_results is None else F.col("matches") >= max_results
    return totals.withColumn("truncated", cut)


def classify_files(docs: DataFrame, cap: int) -> DataFrame:
    """Which files a scan would skip: binary, or larger than ``cap`` bytes."""
    size = F.octet_length("content")
    return docs.select(
        "scope",
        "path",
        size.cast("long").alias("size_bytes"),
        is_binary(F.col("content")).alias("binary"),
        (size > cap).alias("too_large"),
    )
