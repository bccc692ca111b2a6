"""Toxicity by two Kneser-Ney bigram models, one of toxic and one of ordinary documents.

Each class has discounted bigrams over its own continuation counts, and those fall back to the continuation counts of both
classes together, so that an expression that is rare or unseen in one class is judged by what both share. A token's evidence
is the difference of its log-likelihoods. A document is judged by its evidence per token, over the whole text and over
its most toxic window, and by the share of strong evidence; a logistic function of these, learnt from labelled documents that
the models have not seen, gives the score. Every token of a text counts.

Evidence is held in whole units of 2^-20, so sums do not depend on which texts are worked on together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_batch, kept, remainder, texts

SAMPLE = 12_000  # labelled documents that are learnt from, at most
CALIBRATES = 4  # one of so many of them is kept back for the logistic function
VOCABULARY = 300_000  # words that the models tell apart, at most: the most frequent ones seen at least twice
PAIRS = 1_000_000  # bigrams that the models keep, at most: the most frequent ones seen at least twice
UNKNOWN, EDGE = 0, 1  # numbers of other words and of what stands before the first
WINDOW = 24  # tokens
CAP = 5  # a token is no stronger evidence than that, or one repeated passage would decide
STRONG = 2.5  # evidence from here on is strong
LITTLE = 0.01  # strong evidence per token that tells nothing
UNIT = 1 << 20
PIECE = 1 << 20  # letters of a text that are worked on at once; windows end there
RIDGE = 1.0
THRESHOLD = 0.5
LETTERS = re.compile(r"[^\W\d_]+")


def pieces(text: str) -> Iterator[list[str]]:
    """The words of a text in lower case; a very long text comes in several pieces, cut between words where it has any breaks."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end > at and text[end].isalpha() and text[end - 1].isalpha():
                end -= 1
            end = end if end > at else at + PIECE
        yield LETTERS.findall(text[at:end].lower())
        at = end


# ---------------------------------------------------------------- counts


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(w for text in batch["text"].to_pylist() for words in pieces(text) for w in words)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def flows(text: str, numbers: dict[str, int]) -> Iterator[np.ndarray]:
    """The numbers of a text's words, each piece led by what stands before it."""
    before = EDGE
    for words in pieces(text):
        if words:
            flow = np.array([before, *map(numbers.get, words, repeat(UNKNOWN))], np.int64)
            before = flow[-1]
            yield flow


def _pairs(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        total = len(numbers) + 2
        for batch in batches:
            parts = [[], []]
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                parts[toxic] += [flow[:-1] * total + flow[1:] for flow in flows(text, numbers)]
            for toxic, found in enumerate(parts):
                pair, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n0": pa.array(none if toxic else n), "n1": pa.array(n if toxic else none)})

    return run


class Counts(NamedTuple):
    """Of words and kept bigrams; the first axis is the class, and of ``before`` also both classes together."""

    total: int  # words, with the two special ones
    uses: np.ndarray  # (2, word): tokens behind the word
    kinds: np.ndarray  # (2, word): different tokens behind it
    before: np.ndarray  # (3, word): different tokens in front of it
    once: np.ndarray  # (2): bigrams seen once
    twice: np.ndarray
    pair: np.ndarray  # sorted; word before * total + word
    n: np.ndarray  # (2, pair)


def count(sample: DataFrame, numbers: dict[str, int]) -> Counts:
    """Counts of (text, toxic): made by Spark; what comes here is bounded by VOCABULARY and PAIRS."""
    total = len(numbers) + 2
    shared = sample.sparkSession.sparkContext.broadcast(numbers)
    found = sample.select("text", "toxic").mapInArrow(_pairs(shared), "pair bigint, n0 bigint, n1 bigint")
    pairs = kept(found.groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "pairs")
    has = lambda c: F.count(F.when(F.col(c) > 0, 1)).alias(f"k{c[1]}")
    after = pairs.groupBy(F.expr(f"pair div {total}").alias("w")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), has("n0"), has("n1")).toArrow()
    ahead = pairs.groupBy((F.col("pair") % total).alias("w")).agg(has("n0"), has("n1"), F.count(F.lit(1)).alias("both")).toArrow()
    seldom = pairs.agg(*[F.count(F.when(F.col(c) == k, 1)) for k in (1, 2) for c in ("n0", "n1")]).first()
    top = pairs.filter("n0 + n1 > 1").orderBy(F.desc(F.col("n0") + F.col("n1")), "pair").limit(PAIRS).toArrow().sort_by("pair")

    def dense(table: pa.Table, *columns: str) -> np.ndarray:
        out = np.zeros((len(columns), total))
        for row, name in zip(out, columns):
            row[table["w"].to_numpy()] = table[name].to_numpy()
        return out

    return Counts(
        total, dense(after, "n0", "n1"), dense(after, "k0", "k1"), dense(ahead, "k0", "k1", "both"), np.array(seldom[:2], float), np.array(seldom[2:], float),
        top["pair"].to_numpy(), np.stack([top["n0"].to_numpy(), top["n1"].to_numpy()]).astype(float),
    )


# ---------------------------------------------------------------- models


class Evidence(NamedTuple):
    """Differences of log-likelihoods, toxic less ordinary, in units."""

    numbers: dict[str, int]
    word: np.ndarray  # of a word behind one that it was not seen with
    back: np.ndarray  # of leaving the word before for that
    pair: np.ndarray  # bigrams, sorted
    both: np.ndarray  # theirs


def discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once else 0.5


def probabilities(c: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(word), the share that a word before leaves to it, and P(word | word before) of the bigrams, for both classes."""
    shared = (c.before[2] + 1) / (c.before[2].sum() + c.total)
    word, left, pair = np.tile(shared, (2, 1)), np.ones((2, c.total)), np.zeros((2, len(c.pair)))
    first, last = c.pair // c.total, c.pair % c.total
    for k in (0, 1):
        ahead, d = c.before[k], discount(c.once[k], c.twice[k])
        if ahead.sum():
            word[k] = (np.maximum(ahead - d, 0) + np.minimum(ahead, d).sum() * shared) / ahead.sum()
        used = c.uses[k] > 0
        left[k, used] = d * c.kinds[k, used] / c.uses[k, used]
        pair[k] = np.maximum(c.n[k] - d, 0) / np.maximum(c.uses[k][first], 1) + left[k][first] * word[k][last]
    return word, left, pair


def evidence(numbers: dict[str, int], c: Counts) -> Evidence:
    units = lambda p: np.round((np.log(p[1]) - np.log(p[0])) * UNIT).astype(np.int64)
    return Evidence(numbers, *map(units, probabilities(c)[:2]), c.pair, units(probabilities(c)[2]))


def token_evidence(flow: np.ndarray, e: Evidence) -> np.ndarray:
    """Of each token of a flow but the first, which stands before."""
    before, word = flow[:-1], flow[1:]
    out = e.word[word] + e.back[before]
    if len(e.pair):
        key = before * len(e.word) + word
        at = np.searchsorted(e.pair, key).clip(0, len(e.pair) - 1)
        known = e.pair[at] == key
        out[known] = e.both[at[known]]
    return out


FEATURES = 4


def features(text: str, e: Evidence) -> np.ndarray:
    """Evidence per token over the text and in its most toxic window, strong evidence per token, and the text's length; a text
    without words has no evidence."""
    tokens = total = strong = 0
    best = None
    for flow in flows(text, e.numbers):
        x = np.clip(token_evidence(flow, e), -CAP * UNIT, CAP * UNIT)
        tokens += len(x)
        total += int(x.sum())
        strong += int(np.maximum(x - int(STRONG * UNIT), 0).sum())
        width = min(WINDOW, len(x))
        sums = np.r_[0, np.cumsum(x)]
        here = int((sums[width:] - sums[:-width]).max()) / (width + 2)  # a few tokens are little evidence
        best = here if best is None else max(best, here)
    if not tokens:
        return np.array([0, 0, np.log(LITTLE), 0])
    return np.array([total / tokens / UNIT, best / UNIT, np.log(strong / tokens / UNIT + LITTLE), np.log(tokens)])


class Model(NamedTuple):
    evidence: Evidence
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton steps, with a ridge on the weights."""
    rows = np.c_[x, np.ones(len(x))]
    ridge = np.diag([RIDGE] * x.shape[1] + [1e-3])
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(x: np.ndarray, model: Model) -> float:
    z = (x - model.center) / model.scale @ model.weights[:-1] + model.weights[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _features(columns, shared):
    found = np.stack([features(t, shared.value) for t in columns["text"].to_pylist()])
    return {"toxic": columns["toxic"], **{f"x{k}": found[:, k] for k in range(FEATURES)}}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic): the ``sample`` labelled documents that come first by a hash of their id.

    Rows without text, id or a label of 0 or 1 are left out, and a repeated id counts once. Of labels that contradict each other
    the mean counts, 1 from a half on. Texts stay with the executors.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    one = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sampled = kept(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    back = F.pmod(F.xxhash64(F.lit("calibrates"), "doc_id"), F.lit(CALIBRATES)) == 0
    seen = sampled.filter(~back)
    words = seen.select("text").mapInArrow(_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    top = words.orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word").toArrow()["word"].to_pylist()
    numbers = {w: i + 2 for i, w in enumerate(top)}
    e = evidence(numbers, count(seen, numbers))
    shared = docs.sparkSession.sparkContext.broadcast(e)
    schema = "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))
    judged = by_batch(sampled.filter(back).select("text", "toxic"), _features, schema, shared).toArrow().sort_by([(f"x{k}", "ascending") for k in range(FEATURES)])
    x = np.stack([judged[f"x{k}"].to_numpy() for k in range(FEATURES)], 1) if judged.num_rows else np.zeros((0, FEATURES))
    y = judged["toxic"].to_numpy().astype(float)
    center, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    return Model(e, center, scale, logistic((x - center) / scale, y))


def _scored(columns, model):
    scores = [probability(features(t, model.value.evidence), model.value) for t in columns["text"].to_pylist()]
    return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text, held_out).

    A null text counts as empty; a text without words has the score of no evidence. Equal texts have equal scores. Repeated rows and
    null doc_ids give a row each; an empty table gives an empty one; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return by_batch(texts(docs, "held_out"), _scored, "doc_id bigint, held_out boolean, score double, predicted int", shared)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of documents whose crc32 of doc_id is not 0 modulo 5, and score all of ``docs``."""
    usable = labels.select("doc_id", "toxic").filter(remainder("doc_id", 5) != 0)
    rows = texts(docs).withColumn("held_out", remainder("doc_id", 5) == 0)
    return score(rows, learn(rows, usable))
