"""String helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_bytes(text: Column, limit: int) -> Column:
    """Longest prefix of ``text`` that fits in ``limit`` UTF-8 bytes without splitting a character.

    Cutting the encoded bytes may leave an incomplete last character.  A character is at most four bytes, so
    stepping back over the trailing continuation bytes of the cut (at most three) finds the last boundary.
    """
    raw = F.encode(text, "UTF-8")

    def byte_at(position: int) -> Column:
        return F.conv(F.hex(F.substring(raw, position, 1)), 16, 10).cast("int")

    def continues(position: int) -> Column:
        return byte_at(position).between(128, 191)

    cut = (
        F.when(~continues(limit + 1), limit)
        .when(~continues(limit), limit - 1)
        .when(~continues(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    # An ASCII-only string is cut by characters, which avoids re-encoding.
    ascii_only = F.octet_length(text) == F.char_length(text)
    return (
        F.when(F.octet_length(text) <= limit, text)
        .when(ascii_only, F.substring(text, 1, limit))
        .otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))
    )


def snippet_chars(text: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("…"))
    )


def fold_control(text: Column) -> Column:
    """Replace each control character by a middle dot."""
    return F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "·")


def neutralize_formula(text: Column) -> Column:
    """Prefix an apostrophe to a cell a spreadsheet would read as a formula."""
    return F.regexp_replace(text, r"^([=+\-@\t\r])", "'$1")


def glob_to_regex(glob: str, ignore_case: bool = False) -> str:
    """Anchored regex for a shell glob: ``*`` and ``?`` stop at ``/``, ``**`` crosses it."""
    special = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    tokens = re.findall(r"\*\*|\*|\?|[^*?]+", glob)
    body = "".join(special.get(t) or re.sub(r"([^\w\s/])", r"\\\1", t) for t in tokens)
    return ("(?si)" if ignore_case else "(?s)") + f"^{body}$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def glob_match(path: Column, glob: str, ignore_case: bool = False) -> Column:
    """A glob without ``/`` is matched against the last path part, any other against the whole path."""
    subject = path if "/" in glob else basename(path)
    return subject.rlike(glob_to_regex(glob, ignore_case))


def quote_pattern(text: str) -> str:
    """Regex that matches ``text`` literally (Java syntax)."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def is_binary(content: Column) -> Column:
    """A NUL within the first 8 KiB marks a file as binary; works on text."""
    # Cut to as many characters first, so that little is encoded; then to bytes.
    head = F.encode(F.substring(content.cast("string"), 1, 8192), "UTF-8")
    return F.contains(F.substring(head, 1, 8192), F.lit(b"\x00"))


def is_binary_bytes(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def too_large(size: Column, cap: int) -> Column:
    return size > cap
