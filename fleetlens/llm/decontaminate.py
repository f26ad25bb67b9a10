"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark texts.

The patterns are the runs of `window` consecutive words of every item; a shorter item is one pattern. A document is normalised
once, scanned once, and hits are mapped back through its words to offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, stored, texts

#: Characters of benchmark text in one automaton. A larger benchmark is scanned for in several passes, one automaton each.
AUTOMATON_CHARS = 4 << 20

_WORD = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to lower case, bytes outside words to a space; every byte keeps its place.
_NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))

HITS = "array<struct<start:int,end:int,from:int,to:int>>"
_ARROW_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split(b" ")


def patterns(items: list[tuple[str, str]], window: int) -> dict[str, tuple[int, list[int]]]:
    """Pattern, framed by spaces, to its number of words and the positions of the items that hold it."""
    out: dict[str, tuple[int, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        words = [w for w in normal_words(text.encode("utf-8")) if w]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            key = b" ".join([b"", *words[i : i + size], b""]).decode("latin-1")
            _, holders = out.setdefault(key, (size, []))
            if not holders or holders[-1] != k:
                holders.append(k)
    return out


def _automaton(found: dict[str, tuple[int, list[int]]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key, value in found.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


def _scan(items: list[tuple[str, str]], window: int, text: str, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(patterns(items, window))
        for batch in batches:
            count, names, hits = [], [], []
            for raw, earlier, spanned in zip(texts(batch.column(text)), batch.column(f"{prefix}items").to_pylist(), batch.column(f"{prefix}hits").to_pylist()):
                flat = raw.tobytes().translate(_NORMAL) if raw is not None else b""
                words = flat.split()
                count.append(len(words))
                # Latin-1 keeps one character a byte, so that places in the scanned text are places in the joined words.
                line = b" ".join([b"", *words, b""]).decode("latin-1") if words else ""
                found = list(automaton.iter(line)) if len(automaton) else []
                if not found:
                    names.append(earlier), hits.append(spanned)
                    continue
                # Each pattern ends on a space; the number of spaces before it is the number of words up to there.
                spaces = np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
                spans = sorted({(int(spaces[end]) - 1 - size, int(spaces[end]) - 1) for end, (size, _) in found} | {(h["from"], h["to"]) for h in spanned})
                names.append(sorted({items[k][0] for _, (_, holders) in found for k in holders} | set(earlier)))
                body = np.concatenate(([False], np.frombuffer(flat, np.uint8) != 0x20, [False]))
                turn = np.flatnonzero(body[1:] != body[:-1])
                begin, finish = turn[0::2], turn[1::2]
                merged: list[list[int]] = []
                for i, j in spans:
                    if merged and i <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], j)
                    else:
                        merged.append([i, j])
                hits.append([{"start": int(begin[i]), "end": int(finish[j - 1]), "from": i, "to": j} for i, j in merged])
            new = {"n_words": pa.array(count, pa.int64()), "items": pa.array(names, pa.list_(pa.string())), "hits": pa.array(hits, _ARROW_HITS)}
            columns = {name: new.get(name.removeprefix(prefix), column) if name.startswith(prefix) else column for name, column in zip(batch.schema.names, batch.columns)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, chars: int = AUTOMATON_CHARS, text: str = "text", item_id: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, items, hits and n_hit after their own columns, whose names begin with the prefix.

    Words are runs of A-Z, a-z, 0-9 and characters from 0x80 on, A-Z lower-cased. A hit is a maximal span of words under
    occurrences of patterns, with its byte offsets in the UTF-8 text (start, end) and its words (from, to); n_hit is the number of
    words under hits. items are the ids of the items with an occurrence, as sorted strings, each once. Null and empty texts have
    no words; items without words and items without an id are left out. Empty tables on either side give no hits. Columns of
    these names that were there are replaced.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // chars))
    names = {k: f"{prefix}{k}" for k in ("n_words", "items", "hits", "n_hit")}
    out = docs.drop(*names.values()).withColumns({names["n_words"]: F.lit(0).cast("long"), names["items"]: F.array().cast("array<string>"), names["hits"]: F.expr(f"cast(array() as {HITS})")})
    for k in range(passes):
        # About `chars` characters reach the driver at a time; each pass holds one automaton and adds to what the last one found.
        # The table is written between passes, so that neither a plan nor a task holds the items of two.
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k) if passes > 1 else items
        before, out = out, out.mapInArrow(_scan(sorted((r.id, r.text) for r in own.collect()), window, text, prefix), out.schema)
        if k < passes - 1:
            out = stored(out, "scanned")
        if 0 < k < passes - 1:
            discard(before)
    return out.withColumn(names["n_hit"], F.aggregate(names["hits"], F.lit(0).cast("long"), lambda n, h: n + h["to"] - h["from"]))
