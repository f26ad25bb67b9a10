"""Spelling variants: words one edit apart, found by range searches in k-d trees over their letter counts.

One inserted or deleted letter changes the vector of letter counts by one, one replaced letter by two (L1 distance). So the words
near a word have vectors in a ball of radius 2 among those of its own length, and of radius 1 among those one letter longer. Words
of equal vectors are no edit apart, so trees hold each vector once.

A tree over each length is cut in cells: its upper splits are fitted on a bounded sample of vectors, and every vector is filed by
them. A search goes down all branches whose box is near enough, and each cell is searched in a task of its own by a k-d tree over
its own vectors. Vectors found name the letters by which two words may differ; the order of letters is verified by making that
change at each place and looking the word up, so that words of equal letters are not compared with each other. Words of more than
LOOKED_UP letters, which have as many places, are compared letter by letter instead.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in NOISE loses a letter; least length and number of a word; times that a form is more frequent.
NOISE, LEAST_LETTERS, LEAST_USES, TIMES = 97, 5, 3, 2
#: Vectors that the upper splits are fitted on, about; vectors of a cell that they aim at; vectors of a leaf; searches at once.
SAMPLE, CELL, LEAF, BATCH = 1 << 16, 1 << 13, 24, 1 << 15
_INDEX, _SEARCH, _SHORTER = 0, 1, 2
#: Letters of a word up to which its changes are looked up; longer words are compared with each other.
LOOKED_UP = 64


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_uses: int = LEAST_USES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, letters): the words of all texts and their uses; letters are the word's own, in order."""
    runs = docs.select(F.col(doc_id).cast("string").alias("doc"), F.explode(F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    h, size = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    word = F.when(h % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_uses) & (F.length("word") >= least_letters))
    return words.withColumn("letters", F.array_join(F.array_sort(F.filter(F.split("word", ""), lambda c: c != "")), ""))


def letter_rows(strings: list[str]) -> np.ndarray:
    """Code points of strings of one length, one row each."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1)


def by_length(strings: list[str], most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of the strings, in parts of about `most` letters."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        n = int(sizes[part[0]])
        for k in range(0, len(part), step := max(1, most // max(n, 1))):
            yield n, part[k : k + step]


@dataclass
class Upper:
    """The upper part of one length's tree: a split (letter, least count of the right side) or a cell."""

    cell: int = -1
    letter: int = 0
    least: int = 0
    sides: list[Upper] = field(default_factory=list)


def fit_upper(rows: np.ndarray, scale: float, numbers: Iterator[int], most: int) -> Upper:
    """Splits sampled letter rows at the median of the letter that parts them most evenly, down to cells of about `most` vectors."""
    if len(rows) * scale > most and len(rows) > 1:
        kinds, best = np.unique(rows), (0, 0, 0)
        for letter in kinds:
            n = (rows == letter).sum(axis=1)
            for least in {int(np.median(n)), int(np.median(n)) + 1}:
                right = int((n >= least).sum())
                best = max(best, (min(right, len(rows) - right), int(letter), least))
        if best[0]:
            right = (rows == best[1]).sum(axis=1) >= best[2]
            return Upper(letter=best[1], least=best[2], sides=[fit_upper(rows[~right], scale, numbers, most), fit_upper(rows[right], scale, numbers, most)])
    return Upper(next(numbers))


def reach(tree: Upper, rows: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, positions): the cells whose box is within the L1 radius of each row; with radius 0 the cell of each row."""
    counts: dict[int, np.ndarray] = {}

    def down(node: Upper, at: np.ndarray, spent: np.ndarray, box: dict[int, tuple[int, int]]):
        if not len(at):
            return
        if node.cell >= 0:
            yield node.cell, at
            return
        if node.letter not in counts:
            counts[node.letter] = (rows == node.letter).sum(axis=1)
        n = counts[node.letter][at]
        low, high = box.get(node.letter, (0, 1 << 40))
        far = lambda lo, hi: np.maximum(lo - n, 0) + np.maximum(n - hi, 0)
        for side, (lo, hi) in zip(node.sides, ((low, node.least - 1), (node.least, high))):
            now = spent - far(low, high) + far(lo, hi)
            near = now <= radius
            yield from down(side, at[near], now[near], {**box, node.letter: (lo, hi)})

    yield from down(tree, np.arange(len(rows)), np.zeros(len(rows), np.int64), {})


def _filed(trees: dict[int, Upper]):
    def cells(n: int, rows: np.ndarray, radius: int):
        # A length without a sampled vector is one cell.
        return reach(trees[n], rows, radius) if n in trees else [(-n, np.arange(len(rows)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column("letters").to_pylist()
            for n, part in by_length(strings):
                rows = letter_rows([strings[k] for k in part])
                own = np.zeros(len(part), np.int64)
                found = []
                for cell, at in cells(n, rows, 0):
                    own[at] = cell
                    found.append((cell, at, _INDEX))
                # Two vectors of one length meet once: in the cell of the larger number.
                found += [(cell, at[own[at] < cell], _SEARCH) for cell, at in cells(n, rows, 2)]
                found += [(cell, at, _SHORTER) for cell, at in cells(n + 1, rows, 1)]
                for cell, at, kind in found:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell)), pa.array(np.full(len(at), kind, np.int32)), pa.array([strings[k] for k in part[at]], pa.string())], ["cell", "kind", "letters"])

    return run


class Codes:
    """Letter counts as bits: a letter's count of c sets its first c bits, so L1 distances are counts of differing bits."""

    def __init__(self, rows: np.ndarray):
        self.letters = np.unique(rows)
        most = np.array([int((rows == x).sum(axis=1).max()) for x in self.letters])
        self.first, self.most = np.append(0, np.cumsum(most))[:-1], most
        self.words = max(1, -(-int(most.sum()) // 64))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each row of ordered letters, and how many of its letters have no bit here."""
        bits, lost = np.zeros((len(rows), self.words), np.uint64), np.zeros(len(rows), np.int64)
        turn = np.zeros(len(rows), np.int64)
        for k in range(rows.shape[1]):
            turn = np.where(rows[:, k] == rows[:, k - 1], turn + 1, 0) if k else turn
            x = np.minimum(np.searchsorted(self.letters, rows[:, k]), len(self.letters) - 1)
            known = (self.letters[x] == rows[:, k]) & (turn < self.most[x])
            lost += ~known
            at = np.flatnonzero(known)
            place = self.first[x[at]] + turn[at]
            bits[at, place >> 6] |= np.uint64(1) << (place & 63).astype(np.uint64)
        return bits, lost


@dataclass
class Node:
    """A box of vectors: the bits that all of them have and those that some have, and its halves or its vectors."""

    every: np.ndarray
    some: np.ndarray
    at: np.ndarray
    halves: tuple[Node, Node] | None = None


def grow(bits: np.ndarray, at: np.ndarray) -> Node:
    """A k-d tree: each box is halved at the letter and count that part its vectors most evenly."""
    own = bits[at]
    node = Node(np.bitwise_and.reduce(own, axis=0), np.bitwise_or.reduce(own, axis=0), at)
    if len(at) > LEAF:
        spread = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")
        have = spread.sum(axis=0, dtype=np.int64)
        best = int(np.argmin(np.abs(2 * have - len(at))))
        if 0 < have[best] < len(at):  # distinct vectors differ in some bit
            right = spread[:, best] > 0
            del spread, own
            node.halves = grow(bits, at[~right]), grow(bits, at[right])
    return node


def search(tree: Node, bits: np.ndarray, asked: np.ndarray, lost: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked row, indexed row) of all pairs at exactly this distance, box by box; boxes that are farther are pruned."""

    def down(node: Node, who: np.ndarray):
        mine = asked[who]
        far = lost[who] + np.bitwise_count(node.every & ~mine).sum(axis=1, dtype=np.int64) + np.bitwise_count(mine & ~node.some).sum(axis=1, dtype=np.int64)
        who = who[far <= radius]
        if not len(who):
            return
        if node.halves:
            yield from down(node.halves[0], who)
            yield from down(node.halves[1], who)
            return
        apart = np.bitwise_count(asked[who][:, None, :] ^ bits[node.at][None, :, :]).sum(axis=2, dtype=np.int64) + lost[who][:, None]
        i, j = np.nonzero(apart == radius)
        yield who[i], node.at[j]

    yield from down(tree, np.arange(len(asked)))


def _moves(letters: list[str], rows: np.ndarray, asked: list[str], lines: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(letters, out, into, other): taking the letter `out` from a word and putting `into` there leads to the other vector.

    The other vector itself goes along where words are too long to try every place.
    """
    if rows.shape[1] == lines.shape[1]:
        # In order, the vectors first differ at the smaller of the two letters and last at the larger one.
        differ = rows[j] != lines[i]
        first, last = np.argmax(differ, axis=1), differ.shape[1] - 1 - np.argmax(differ[:, ::-1], axis=1)
        a, b, c, d = lines[i, first], rows[j, first], lines[i, last], rows[j, last]
        out, into, source = np.where(a < b, a, c), np.where(a < b, d, b), [asked[k] for k in i.tolist()]
        put, to = [chr(x) for x in into.tolist()], [letters[k] for k in j.tolist()]
    else:
        differ = np.ones((len(i), rows.shape[1]), bool)
        differ[:, :-1] = rows[j][:, :-1] != lines[i]
        out, source = rows[j, np.argmax(differ, axis=1)], [letters[k] for k in j.tolist()]
        put, to = [""] * len(i), [asked[k] for k in i.tolist()]
    if rows.shape[1] <= LOOKED_UP:
        to = [None] * len(i)
    return pa.RecordBatch.from_pydict({"letters": pa.array(source, pa.string()), "out": pa.array([chr(x) for x in out.tolist()], pa.string()), "into": pa.array(put, pa.string()), "other": pa.array(to, pa.string())})


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves between near vectors, from rows sorted by cell and kind. A cell's vectors are held; searches pass through in parts."""
    cell, letters, state = None, [], None

    def ready():
        nonlocal state
        if state is None and letters:
            rows = letter_rows(letters)
            codes = Codes(rows)
            bits, _ = codes.of(rows)
            state = rows, codes, bits, grow(bits, np.arange(len(bits)))
        return state

    def answers(asked: list[str], kind: int) -> Iterator[pa.RecordBatch]:
        if not asked or ready() is None:
            return
        rows, codes, bits, tree = state
        lines = letter_rows(asked)
        mine, lost = codes.of(lines)
        own = kind == _INDEX
        for i, j in search(tree, bits, mine, lost, 1 if kind == _SHORTER else 2):
            if own:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), BATCH):
                yield _moves(letters, rows, asked, lines, i[k : k + BATCH], j[k : k + BATCH])

    def parts(strings: list[str]) -> Iterator[list[str]]:
        step = max(1, min(BATCH, (1 << 22) // max(1, len(strings[0]))))
        for k in range(0, len(strings), step):
            yield strings[k : k + step]

    for batch in batches:
        if not batch.num_rows:
            continue
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            strings = batch.column("letters").slice(lo, hi - lo).to_pylist()
            if cells[lo] != cell:
                if state is None and letters:
                    yield from answers(letters, _INDEX)
                cell, letters, state = cells[lo], [], None
            if kinds[lo] == _INDEX:
                letters += strings
                continue
            if state is None and letters:
                yield from answers(letters, _INDEX)
            for some in parts(strings):
                yield from answers(some, int(kinds[lo]))
    if state is None and letters:
        yield from answers(letters, _INDEX)


def moves(vectors: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(letters, out, into, other) for all pairs of vectors (letters) that one edit may part; one direction of each pair.

    A word of `letters` becomes one of the other vector where `into` stands for one of its letters `out`; `into` is empty where the
    other is one letter shorter. other is null up to LOOKED_UP letters. Vectors are distinct. The sample bounds what the driver reads to fit the upper splits; it decides
    how cells are cut and no result.
    """
    total = vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64("letters"), F.lit(max(1, total // sample))) == 0).toArrow().column("letters").to_pylist()
    numbers, trees = itertools.count(), {}
    grouped: dict[int, list[np.ndarray]] = {}
    for n, at in by_length(chosen):
        grouped.setdefault(n, []).append(letter_rows([chosen[k] for k in at]))
    for n, rows in grouped.items():
        trees[n] = fit_upper(np.concatenate(rows), total / max(1, len(chosen)), numbers, cell)
    filed = vectors.mapInArrow(_filed(trees), "cell long, kind int, letters string")
    # One task for about each cell: the work is the search, not the bytes.
    dealt = filed.repartition(max(1, next(numbers)), "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_searched, "letters string, out string, into string, other string")


def near_words(words: DataFrame, found: DataFrame) -> DataFrame:
    """(word, n, other, other_n): pairs of words that differ by one letter, each in one direction, from moves() of their vectors."""
    size = F.length("word")
    places = F.filter(F.sequence(F.lit(1), size), lambda k: F.substring("word", k, F.lit(1)) == F.col("out"))
    made = F.array_distinct(F.transform(places, lambda k: F.concat(F.substring("word", F.lit(1), k - 1), F.col("into"), F.substring("word", k + 1, size))))
    # Both sides grow with the vocabulary: they sort and merge at every size.
    tried = words.join(found.where("other is null").drop("other").hint("merge"), "letters").select("word", "n", F.explode_outer(made).alias("other"))
    looked_up = tried.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other").select("word", "n", "other", "other_n")
    theirs = words.select(F.col("letters").alias("to"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    ends = words.join(found.where("other is not null").select("letters", F.col("other").alias("to")).hint("merge"), "letters").join(theirs.hint("merge"), "to")
    return looked_up.union(ends.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, at): the last word on the chain of forms (word, form) from each of them; every round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("at"), F.lit(True).alias("moved")), "forms")
    while not now.where("moved").isEmpty():
        ahead = now.select(F.col("word").alias("_word"), F.col("at").alias("_at"))
        after = now.join(ahead.hint("merge"), F.col("at") == F.col("_word"), "left").select("word", F.coalesce("_at", "at").alias("at"), F.col("_at").isNotNull().alias("moved"))
        now, before = stored(after, "forms"), now
        discard(before)
    return now.select("word", "at")


def group_variants(words: DataFrame, found: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word (word, n, letters)."""
    pairs = near_words(words, found)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    every = words.select("word", "n").unionByName(both, allowMissingColumns=True)
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    each = every.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    each = stored(each.select("word", "n", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "near")
    last = roots(each.where("form is not null"))
    return each.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("at", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """The words of all texts with the more frequent word one edit away that each is a variant of, and the end of that chain.

    (word, form, root, n, n_near, form_n). Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of 5 letters
    and 3 uses or more; in one of 97 runs, told by the crc32 of its document and text, a letter is left out first. form is the near
    word of the largest n, the first in code-point order among equals, if that n is at least twice the word's.

    Null and empty texts have no words; long texts and long words are read whole. A row without an id keeps all its letters. Repeated
    rows count again. Extra columns are not read. An empty table gives an empty result.
    """
    words = stored(count_words(docs, doc_id=doc_id, text=text), "words")
    found = stored(moves(stored(words.select("letters").distinct(), "vectors"), sample, cell), "moves")
    return group_variants(words, found)
