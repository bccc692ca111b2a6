"""Language identification by unigram models over the pieces of a fixed vocabulary.

A word's probability in a language is the sum, over every way to cut the word into pieces, of the
products of the pieces' probabilities; a forward pass over the lattice of pieces adds them all up.
Training is expectation maximisation over word counts: forward and backward passes give each piece's
expected count in every segmentation, Spark adds them up, and the sums become the next probabilities.
Only sums per (language, piece) reach the driver: at most languages x vocabulary numbers.

Words are maximal runs of letters in lower case with the vocabulary's word mark in front, of any length: they are worked
out in batches of bounded size by length, a longer word than that alone, in memory in proportion to its letters. A word whose products
come near underflow, such as a run of letters that no language has shown, is worked out once more in logarithms.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_batch, filter_batches, kept, remainder

MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
ROUNDS = 4
UNKNOWN = 1e-5  # probability of a character that no piece has
PRIOR = 0.5  # count that is shared out to all pieces by their frequency in all languages together
FLUSH = 400_000  # distinct words counted before a batch of counts goes out
BATCH, CELLS = 20_000, 1_000_000  # words, and places of lattices, that are worked out at once
LEAST = 1e-250  # words below this probability are worked out in logarithms
MEMO = 400_000  # words whose probabilities a worker remembers


class Model(NamedTuple):
    languages: list[str]
    probability: np.ndarray  # (pieces + 1, languages); the last row is the unknown character


class Edges(NamedTuple):
    """Pieces in words, ordered by where they end."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


class Lattice:
    """The vocabulary as a trie in arrays, walked from all places of many words at once."""

    def __init__(self, vocabulary: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=vocabulary)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.pieces = len(names)
        self.number = {name: i for i, name in enumerate(names)}
        # Characters get small numbers; 0 is any that no piece has, and the end of a word.
        letters = sorted({ord(c) for name in names for c in name})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.radix = len(letters) + 1
        state = {"": 0}
        moves: dict[int, int] = {}
        for name in names:
            for end in range(1, len(name) + 1):
                if name[:end] not in state:
                    state[name[:end]] = len(state)
                    moves[state[name[: end - 1]] * self.radix + int(self.letter[ord(name[end - 1])])] = state[name[:end]]
        self.keys = np.array(sorted(moves), np.int64)
        self.target = np.array([moves[k] for k in self.keys.tolist()], np.int64)
        self.piece_at = np.full(len(state), -1, np.int64)
        for name, number in self.number.items():
            self.piece_at[state[name]] = number

    def edges(self, words: list[str]) -> Edges:
        """Every piece in every word; a character that is no piece by itself is an edge of the unknown piece."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        letters = self.letter[codes] * (codes != 0)
        word = np.repeat(np.arange(len(words)), lengths)
        begin = np.cumsum(lengths + 1) - lengths - 1
        start = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place, at, state = begin[word] + start, np.arange(len(word)), np.zeros(len(word), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        length = 0
        while len(at):
            key = state * self.radix + letters[place[at] + length]
            to = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[to] == key) & (letters[place[at] + length] > 0)
            length += 1
            if length == 1:
                single = np.zeros(len(at), bool)
                single[hit] = self.piece_at[self.target[to[hit]]] >= 0
                lone = at[~single]
                found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.pieces)))
            at, state = at[hit], self.target[to[hit]]
            piece = self.piece_at[state]
            is_piece = piece >= 0
            found.append((at[is_piece], np.full(int(is_piece.sum()), length), piece[is_piece]))
        at, size, piece = (np.concatenate(x) for x in zip(*found))
        # Short numbers are sorted by radix.
        end = (start[at] + size).astype(np.int16 if lengths.max(initial=0) < 1 << 15 else np.int64)
        order = np.argsort(end, kind="stable")
        at = at[order]
        return Edges(word[at], start[at], end[order].astype(np.int64), piece[order])


def by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of all words, the shortest first, in batches whose lattices have at most CELLS places, or one word."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        part = order[at : at + BATCH]
        # Padded to its longest word, a batch that ends here has this many places.
        size = np.arange(1, len(part) + 1) * (lengths[part] + 1)
        take = max(1, int(np.searchsorted(size, CELLS, "right")))
        yield part[:take]
        at += take


@functools.lru_cache(maxsize=2)
def lattice(vocabulary: str) -> Lattice:
    return Lattice(vocabulary)


def _by_end(edges: Edges, positions: int) -> list[slice]:
    bounds = np.searchsorted(edges.end, np.arange(1, positions + 1))
    return [slice(bounds[e - 1], bounds[e]) for e in range(1, positions)]


def forward(lengths: np.ndarray, edges: Edges, weight: np.ndarray) -> np.ndarray:
    """alpha[word, position]: sum over all segmentations of the word's beginning; ``weight`` is per edge."""
    positions = int(lengths.max()) + 1
    alpha = np.zeros((len(lengths), positions))
    alpha[:, 0] = 1
    flat = alpha.ravel()
    source, to = edges.word * positions + edges.start, edges.word * positions + edges.end
    for part in _by_end(edges, positions):
        np.add.at(flat, to[part], flat[source[part]] * weight[part])
    return alpha


def backward(lengths: np.ndarray, edges: Edges, weight: np.ndarray) -> np.ndarray:
    """beta[word, position]: sum over all segmentations of the word's rest."""
    positions = int(lengths.max()) + 1
    beta = np.zeros((len(lengths), positions))
    beta[np.arange(len(lengths)), lengths] = 1
    flat = beta.ravel()
    source, to = edges.word * positions + edges.start, edges.word * positions + edges.end
    for part in reversed(_by_end(edges, positions)):
        np.add.at(flat, source[part], flat[to[part]] * weight[part])
    return beta


def log_forward(lengths: np.ndarray, edges: Edges, logs: np.ndarray) -> np.ndarray:
    """Logarithms of ``forward``, of any size; ``logs`` are those of the weights."""
    positions = int(lengths.max()) + 1
    alpha = np.full((len(lengths), positions), -np.inf)
    alpha[:, 0] = 0
    flat = alpha.ravel()
    source, to = edges.word * positions + edges.start, edges.word * positions + edges.end
    for part in _by_end(edges, positions):
        np.logaddexp.at(flat, to[part], flat[source[part]] + logs[part])
    return alpha


def log_backward(lengths: np.ndarray, edges: Edges, logs: np.ndarray) -> np.ndarray:
    """Logarithms of ``backward``, of any size."""
    positions = int(lengths.max()) + 1
    beta = np.full((len(lengths), positions), -np.inf)
    beta[np.arange(len(lengths)), lengths] = 0
    flat = beta.ravel()
    source, to = edges.word * positions + edges.start, edges.word * positions + edges.end
    for part in reversed(_by_end(edges, positions)):
        np.logaddexp.at(flat, source[part], flat[to[part]] + logs[part])
    return beta


def shares(lengths: np.ndarray, edges: Edges, weight: np.ndarray) -> np.ndarray:
    """The part of each edge's word's probability that goes through the edge."""
    word, start, end, piece = edges
    alpha, beta = forward(lengths, edges, weight), backward(lengths, edges, weight)
    whole = alpha[np.arange(len(lengths)), lengths]
    share = alpha[word, start] * weight * beta[word, end] / np.maximum(whole, LEAST)[word]
    low = np.flatnonzero(whole < LEAST)
    if len(low):
        at = np.flatnonzero(np.isin(word, low))
        few = Edges(np.searchsorted(low, word[at]), start[at], end[at], piece[at])
        logs = np.log(weight[at])
        alpha, beta = log_forward(lengths[low], few, logs), log_backward(lengths[low], few, logs)
        share[at] = np.exp(alpha[few.word, few.start] + logs + beta[few.word, few.end] - alpha[few.word, lengths[low][few.word]])
    return share


def word_logs(words: list[str], vocabulary: str, probability: np.ndarray) -> np.ndarray:
    """(word, language): logarithm of each word's probability, finite however small that is."""
    found = word_probabilities(words, vocabulary, probability)
    logs = np.log(np.maximum(found, LEAST))
    low = np.flatnonzero(found.min(1, initial=1) < LEAST)
    if len(low):
        marked = [MARK + words[i] for i in low]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        edges = lattice(vocabulary).edges(marked)
        each = np.arange(len(marked))
        logs[low] = np.stack([log_forward(lengths, edges, p[edges.piece])[each, lengths] for p in np.log(probability).T], 1)
    return logs


def word_probabilities(words: list[str], vocabulary: str, probability: np.ndarray) -> np.ndarray:
    """(word, language): each word's probability, all segmentations summed."""
    marked = [MARK + w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    edges = lattice(vocabulary).edges(marked)
    each = np.arange(len(marked))
    return np.stack([forward(lengths, edges, p[edges.piece])[each, lengths] for p in np.ascontiguousarray(probability.T)], 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            if words:
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(words)), "word": pa.array(list(words)), "n": pa.array(list(words.values()), pa.int64())
                })
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, counts.values())) > FLUSH:
                yield from out()
    yield from out()


def _expected(vocabulary: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, probability = model.value
        place = {lang: i for i, lang in enumerate(languages)}
        total = np.zeros(probability.shape)
        for batch in batches:
            words = [MARK + w for w in batch["word"].to_pylist()]
            langs = np.fromiter((place[x] for x in batch["lang"].to_pylist()), np.int64, len(words))
            counts = batch["n"].to_numpy().astype(float)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for part in by_length(sizes):
                lang, n = langs[part], counts[part]
                edges = lattice(vocabulary).edges([words[i] for i in part])
                word, piece = edges.word, edges.piece
                share = n[word] * shares(sizes[part], edges, probability[piece, lang[word]])
                total += np.bincount(piece * len(languages) + lang[word], share, total.size).reshape(total.shape)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": pa.array(total[piece, lang])})

    return run


def train(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of every language in ``lang``, learnt from (text, lang).

    Rows with a null text or lang teach nothing; without rows there are no languages. Memory on the driver
    is vocabulary x languages, so ``lang`` must hold languages, not free text.
    """
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    counted = labelled.mapInArrow(_counted, "lang string, word string, n bigint")
    counts = kept(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    pieces = lattice(vocabulary).pieces
    probability = np.full((pieces + 1, len(languages)), 1 / pieces)
    probability[pieces] = UNKNOWN
    context = docs.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        model = context.broadcast((languages, probability))
        sums = counts.mapInArrow(_expected(vocabulary, model), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n"))
        expected = np.zeros(probability.shape)
        for piece, lang, n in sums.collect():
            expected[piece, lang] = n
        expected = expected[:pieces]
        common = expected.sum(1) + 1e-3
        expected += PRIOR * pieces * common[:, None] / common.sum()
        probability = np.vstack([expected / expected.sum(0), np.full((1, len(languages)), UNKNOWN)])
        model.unpersist()
    return Model(languages, probability)


class _Memo:
    """Log probabilities of words seen by this worker, for one model; a column per word."""

    def __init__(self, key: str, languages: int) -> None:
        self.key = key
        self.place: dict[str, int] = {}
        self.logs = np.zeros((languages, 1 << 12))

    def learn(self, words: set[str], vocabulary: str, probability: np.ndarray) -> None:
        fresh = list(words.difference(self.place))
        first = len(self.place)
        while self.logs.shape[1] < first + len(fresh):
            self.logs = np.hstack([self.logs, np.zeros_like(self.logs)])
        for part in by_length(np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1):
            self.logs[:, first + part] = word_logs([fresh[i] for i in part], vocabulary, probability).T
        self.place.update(zip(fresh, range(first, first + len(fresh))))


_memo: _Memo | None = None


def _languages(texts: list[str | None], vocabulary: str, model) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    global _memo
    key, languages, probability = model.value
    if _memo is None or _memo.key != key or len(_memo.place) > MEMO:
        _memo = _Memo(key, len(languages))
    found, scores = [], []
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    if languages:
        _memo.learn(set(chain.from_iterable(words)), vocabulary, probability)
    place = _memo.place.__getitem__
    for ws in words:
        if not languages or not any(c.isalpha() for w in ws for c in w):
            found.append("und")
            scores.append(0.0)
            continue
        total = _memo.logs.take(np.fromiter(map(place, ws), np.int64, len(ws)), 1).sum(1)
        best = int(total.argmax())
        found.append(languages[best])
        scores.append(float(1 / np.exp(total - total[best]).sum()))
    return found, scores


def _predicted(columns, vocabulary, model):
    found, scores = _languages(columns["text"].to_pylist(), vocabulary, model)
    return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": found, "score": scores}


def _accepted(columns, vocabulary, model, least):
    found, scores = _languages(columns["text"].to_pylist(), vocabulary, model)
    return [lang != "und" and score >= least for lang, score in zip(found, scores)]


def _shared(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(model.languages), model.probability))


def predict(docs: DataFrame, model: Model, vocabulary: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of (doc_id, text, held_out).

    ``score`` is the language's posterior probability with equal priors; ties go to the first language in
    alphabetical order. A text that is null or has no letter, or any text when no language was learnt, is
    ``und`` with score 0. Repeated rows and null doc_ids give a row each.
    """
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    return by_batch(docs.select("doc_id", "text", "held_out"), _predicted, schema, vocabulary, _shared(docs, model))


def accepted(docs: DataFrame, model: Model, vocabulary: str, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a language with a score of ``least`` or more."""
    return filter_batches(docs, _accepted, vocabulary, _shared(docs, model), least)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from: crc32 of doc_id is not 1 modulo 3."""
    return docs.select("doc_id", "text", "lang").filter(remainder("doc_id", 3) != 1)


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Learn from two thirds of ``documents`` (crc32 of doc_id modulo 3 is not 1) and predict all of it.

    Other columns than doc_id, text and lang are not looked at; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    return predict(rows.withColumn("held_out", remainder("doc_id", 3) == 1), train(learnable(rows), vocabulary), vocabulary)
