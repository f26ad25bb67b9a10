"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary, fitted by expectation maximisation on word counts of a bounded
sample. A word's likelihood is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over
its words. Words are lower-cased runs of letters with the vocabulary's word mark in front.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import mix, stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language that the model is fitted on, and rounds of fitting.
MAX_ROWS, ROUNDS = 2_000, 3
#: A longer run of letters is scored in parts of this many characters, each as a word.
LONGEST = 64
#: Words whose scores a task remembers.
REMEMBERED = 300_000
UNDETERMINED = "und"
_MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
#: Keeps products of piece probabilities in range: each piece is weighted by this to the power of its length.
_LIFT = 24.0
#: Sums beyond this, or below its inverse, are scaled anew.
_FAR = 1e60
_MULTIPLIER = 0x9E3779B97F4A7C15
_SLOTS = 20


@dataclass
class Vocabulary:
    """Pieces by hash, in an open-addressed table; index 0 stands for none and 1 for an unknown character."""

    keys: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    longest: int
    probes: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(hashes.shape, np.int32)
        at = (mix(hashes) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        for step in range(self.probes):
            slot = (at + step) & ((1 << _SLOTS) - 1)
            hit = self.keys[slot] == hashes
            out[hit] = self.ids[slot[hit]]
        return out


def _codes(words: list[str]) -> np.ndarray:
    return np.array(words).view(np.uint32).reshape(len(words), -1)


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The lower-case pieces made of letters of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({p for i in range(model.get_piece_size()) if (b := (p := model.id_to_piece(i)).removeprefix(_MARK)) == "" and p or b and _LETTERS.fullmatch(b) and b == b.lower()})
    keys, ids, probes = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32), 1
    for k, p in enumerate(pieces, 2):
        h = _spans(_codes([p]), len(p))[len(p) - 1][:, 0]
        at = int(mix(h)[0] >> np.uint64(64 - _SLOTS))
        step = 0
        while ids[(at + step) % len(ids)]:
            step += 1
        keys[(at + step) % len(ids)], ids[(at + step) % len(ids)] = h[0], k
        probes = max(probes, step + 1)
    return Vocabulary(keys, ids, np.array([0, 1, *map(len, pieces)]), max(map(len, pieces)), probes)


def _spans(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length up to the longest, hashes of all substrings of that length."""
    out = []
    with np.errstate(over="ignore"):
        codes = codes.astype(np.uint64)
        h = np.zeros(codes.shape, np.uint64)
        for k in range(min(longest, codes.shape[1])):
            h = h[:, : codes.shape[1] - k] * np.uint64(_MULTIPLIER) + codes[:, k:] + np.uint64(1)
            out.append(h)
    return out


def _lattice(vocabulary: Vocabulary, codes: np.ndarray) -> list[np.ndarray]:
    """Piece of each substring, by length; a single character without a piece is an unknown one."""
    out = [vocabulary.find(h) for h in _spans(codes, vocabulary.longest)]
    out[0][out[0] == 0] = 1
    return out


def _forward(pieces: list[np.ndarray], p: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Likelihood of each prefix, summed over its segmentations, as a factor and the logarithm of its scale.

    p has a row for each piece and a column for each language. A factor that leaves the range of `_FAR` sets a new scale for its
    word and language, which the positions that pieces still reach back to take on.
    """
    near = [np.ones((len(pieces[0]), p.shape[1]))]
    alpha, scale = [near[0]], [np.zeros_like(near[0])]
    for j in range(1, size + 1):
        total = np.zeros_like(near[0])
        for k in range(1, min(j, len(pieces)) + 1):
            ids = pieces[k - 1][:, j - k]
            used = np.flatnonzero(ids)
            if len(used) * 2 > len(ids):
                total += near[-k] * p[ids]
            elif len(used):
                total[used] += near[-k][used] * p[ids[used]]
        alpha.append(total)
        scale.append(scale[-1])
        near = [*near, total][-len(pieces) :]
        far = (total < 1 / _FAR) | (total > _FAR)
        if far.any():
            by = np.where(far, total, 1.0)
            near = [x / by for x in near]
            alpha[-1], scale[-1] = near[-1], scale[-1] + np.log(by)
    return alpha, scale


def _by_size(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words = [_MARK + w for w in words]
    sizes = np.array(list(map(len, words)), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), 20_000):
            part = at[i : i + 20_000]
            yield part, _codes([words[k] for k in part])


def lifted(vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    out = p * _LIFT ** vocabulary.lengths[:, None]
    out[0] = 0
    return out


def word_scores(vocabulary: Vocabulary, p: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-likelihood of each word under each language; p is lifted."""
    out = np.zeros((len(words), p.shape[1]))
    for at, codes in _by_size(words):
        size = codes.shape[1]
        alpha, scale = _forward(_lattice(vocabulary, codes), p, size)
        out[at] = np.log(alpha[-1]) + scale[-1] - size * np.log(_LIFT)
    return out


def words_of(text: str) -> list[str]:
    return _PARTS.findall(text.lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            seen.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _expected(vocabulary: Vocabulary, p: np.ndarray, langs: list[str]):
    """Expected uses of each piece: forward times backward over each word, weighted by the word's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(p.shape)
        for batch in batches:
            of = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for k in range(len(langs)):
                mine = np.flatnonzero(of == k)
                own = p[:, k : k + 1]
                for at, codes in _by_size([words[i] for i in mine]):
                    size, pieces = codes.shape[1], _lattice(vocabulary, codes)
                    alpha, up = _forward(pieces, own, size)
                    beta, down = (x[::-1] for x in _forward([x[:, ::-1] for x in pieces], own, size))
                    weight = n[mine[at]] / alpha[-1][:, 0]
                    for length, ids in enumerate(pieces, 1):
                        for i in range(ids.shape[1]):
                            scale = np.exp(up[i] + down[i + length] - up[-1])[:, 0]
                            np.add.at(use[:, k], ids[:, i], weight * alpha[i][:, 0] * own[ids[:, i], 0] * beta[i + length][:, 0] * scale)
        use[0] = 0
        piece, lang = np.nonzero(use)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(use[piece, lang])], ["piece", "lang", "use"])

    return run


@dataclass
class Model:
    vocabulary: Vocabulary
    langs: list[str]
    p: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, usable: Column, vocabulary: str = VOCABULARY, max_rows: int = MAX_ROWS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Piece probabilities learned from about max_rows documents of each language, chosen by a hash of their id.

    Rows with a null language, id or text are left out. Without any row there is no language, and every prediction is `und`.
    """
    pieces = load_vocabulary(vocabulary)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(usable).where("doc_id is not null and text is not null and lang is not null")
    share = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model(pieces, [], np.zeros((len(pieces.lengths), 0)), np.zeros(0))
    limits = F.create_map(*[F.lit(x) for k in langs for x in (k, int((1 << 20) * min(1.0, max_rows / share[k])))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < limits[F.col("lang")])
    words = stored(sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    p = np.full((len(pieces.lengths), len(langs)), 1.0 / len(pieces.lengths))
    for _ in range(rounds):
        # One row for each piece and language at most.
        use = words.mapInArrow(_expected(pieces, lifted(pieces, p), langs), "piece int, lang int, use double").groupBy("piece", "lang").agg(F.sum("use").alias("use")).toArrow()
        p = np.full(p.shape, 0.02)
        p[use.column("piece").to_numpy(), use.column("lang").to_numpy()] += use.column("use").to_numpy()
        p[0] = 0
        p /= p.sum(axis=0)
    prior = np.array([share[k] for k in langs], float)
    return Model(pieces, langs, lifted(pieces, p), np.log(prior / prior.sum()))


def _slices(values: pa.Array) -> Iterator[list[Counter]]:
    """Word counts of the texts, for some millions of characters at a time."""
    held, size = [], 0
    for value in values:
        text = value.as_py() or ""
        held.append(Counter(words_of(text)))
        size += len(text)
        if size > 4_000_000:
            yield held
            held, size = [], 0
    yield held


def _predicted(model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        scores = np.zeros((0, len(model.langs)))
        for batch in batches:
            pred, conf = [], []
            for part in _slices(batch.column(text)):
                new = list(set().union(*part) - known.keys())
                if len(known) + len(new) > REMEMBERED:
                    known, scores, new = {}, scores[:0], list(set().union(*part))
                if new and model.langs:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    scores = np.concatenate([scores, word_scores(model.vocabulary, model.p, new)])
                for counts in part:
                    if not counts or not model.langs:
                        pred.append(UNDETERMINED), conf.append(0.0)
                        continue
                    at = list(map(known.__getitem__, counts))
                    total = np.fromiter(counts.values(), float, len(counts)) @ scores[at] + model.prior
                    total = np.exp(total - total.max())
                    best = int(total.argmax())
                    pred.append(model.langs[best]), conf.append(float(total[best] / total.sum()))
            out = batch
            for name, column in (("lang_pred", pa.array(pred, pa.string())), ("score", pa.array(conf, pa.float64()))):
                out = out.append_column(name, column)
            yield out

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (its share among the languages) after its own columns.

    Null texts and texts without a letter are `und` with score 0. Columns of these names that were there are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predicted(model, text), schema)
