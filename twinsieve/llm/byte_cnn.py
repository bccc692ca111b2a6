"""Quality scores by a byte-level convolutional network, in numpy.

A filter looks at WIDTH bytes; its weights are one number per place and byte value. Responses are taken at every
place of the document, and their maxima over overlapping chunks (two neighbouring blocks each) go through a
small hidden layer. The document's mean and maximum of the hidden units give one logit. Filters, hidden layer and
output are learnt together by Adam on a bounded sample of labelled documents, each with all of its chunks.

The scores of a document depend on all of its bytes and on nothing else.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import by_batch, filter_batches, kept, remainder, texts

WIDTH = 6
FILTERS = 24
HIDDEN = 24
BLOCK = 64  # places in a block; a chunk is two blocks
SAMPLE = 3000  # labelled documents that are learnt from, at most
SAMPLE_BYTES = 32 << 20  # bytes of text that they have together, at most
EPOCHS = 8
BATCH = 48  # documents
THRESHOLD = 0.3
PIECE = 1024 * BLOCK  # places whose responses are held at once
CHUNKS = 512  # chunks of a training batch whose responses are held at once


class Net(NamedTuple):
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    hidden: np.ndarray  # (FILTERS + 1, HIDDEN), the last row is the bias
    out: np.ndarray  # (2 * HIDDEN + 1)


# ---------------------------------------------------------------- training


def training_bytes(text: str) -> np.ndarray:
    """Bytes of a sampled document; -1 behind its end."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.int16)
    if len(b) < WIDTH:
        b = np.r_[b, np.zeros(WIDTH - len(b), np.int16)]
    return np.r_[b, np.full(2 * BLOCK + WIDTH, -1, np.int16)]


def training_chunks(padded: np.ndarray) -> np.ndarray:
    """(chunk, bytes) of all the chunks of a document's ``training_bytes``."""
    places = len(padded) - 2 * BLOCK - 2 * WIDTH + 1
    blocks = -(-places // BLOCK)
    starts = np.arange(max(1, blocks - 1)) * BLOCK
    return padded[starts[:, None] + np.arange(2 * BLOCK + WIDTH - 1)]


def _pooled(taps: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima over each chunk, and where they are."""
    parts = [_pooled_part(taps, x[at : at + CHUNKS]) for at in range(0, len(x), CHUNKS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _pooled_part(taps: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = 2 * BLOCK
    safe = np.maximum(x, 0)
    response = taps[0][safe[:, :n]]
    for j in range(1, WIDTH):
        response += taps[j][safe[:, j : n + j]]
    response[x[:, WIDTH - 1 :] < 0] = -1e9
    at = response.argmax(1)
    return np.take_along_axis(response, at[:, None], 1)[:, 0], at


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(documents: list[str], labels: np.ndarray, seed: int = 7) -> Net:
    """Learn from texts and labels 0 or 1; without both labels the net says how often 1 occurs (0.5 without any)."""
    rng = np.random.default_rng(seed)
    params = [
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.vstack([rng.normal(0, 0.4, (FILTERS, HIDDEN)), np.zeros((1, HIDDEN))]).astype(np.float32),
        np.r_[rng.normal(0, 0.2, 2 * HIDDEN), 0.0].astype(np.float32),
    ]
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        params[2][:] = 0
        params[2][-1] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Net(*params)
    read = [training_bytes(t) for t in documents]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    rounds = EPOCHS * -(-len(read) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(read))
        for at in range(0, len(order), BATCH):
            step += 1
            rate = 0.01 * (1 - step / (rounds + 1))
            grads = _gradients(params, [training_chunks(read[i]) for i in order[at : at + BATCH]], labels[order[at : at + BATCH]])
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Net(*params)


def _gradients(params, chunks, labels):
    taps, hidden, out = params
    x = np.concatenate(chunks)
    counts = np.array([len(c) for c in chunks])
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    doc = np.repeat(np.arange(len(chunks)), counts)
    raw, at = _pooled(taps, x)
    p = np.maximum(raw, 0)
    h = np.maximum(p @ hidden[:-1] + hidden[-1], 0)
    mean = np.add.reduceat(h, starts) / counts[:, None]
    most = np.maximum.reduceat(h, starts)
    z = mean @ out[:HIDDEN] + most @ out[HIDDEN:-1] + out[-1]
    dz = ((_sigmoid(z) - labels) / len(chunks)).astype(np.float32)
    d_out = np.r_[dz @ mean, dz @ most, dz.sum()].astype(np.float32)
    is_most = h == most[doc]
    ties = np.add.reduceat(is_most, starts, dtype=np.float32)
    dh = dz[doc, None] * (out[:HIDDEN] / counts[doc, None] + out[HIDDEN:-1] * is_most / ties[doc])
    dh[h <= 0] = 0
    d_hidden = np.vstack([p.T @ dh, dh.sum(0)]).astype(np.float32)
    dp = dh @ hidden[:-1].T
    dp[raw <= 0] = 0
    d_taps = np.zeros_like(taps)
    rows, filters = np.nonzero(dp)
    place = at[rows, filters]
    for j in range(WIDTH):
        np.add.at(d_taps[j], (np.maximum(x[rows, place + j], 0), filters), dp[rows, filters])
    return d_taps, d_hidden, d_out


# ---------------------------------------------------------------- scoring


class Scorer:
    """A net with its filters as tables over pairs of bytes."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self.pairs = [(net.taps[j][:, None] + net.taps[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, WIDTH, 2)]

    def blocks(self, b: np.ndarray) -> np.ndarray:
        """Maxima of the responses over each block; works through long documents piece by piece."""
        found = []
        places = len(b) - WIDTH + 1
        for at in range(0, places, PIECE):
            part = b[at : at + PIECE + WIDTH - 1].astype(np.int32)
            pair = part[:-1] << 8 | part[1:]
            n = len(part) - WIDTH + 1
            response = self.pairs[0][pair[:n]]
            for k, table in enumerate(self.pairs[1:], 1):
                response += table[pair[2 * k : 2 * k + n]]
            found.append(np.maximum.reduceat(response, np.arange(0, n, BLOCK)))
        return np.concatenate(found)

    def score(self, text: str) -> float:
        b = np.frombuffer(text.encode(), np.uint8)
        if len(b) < WIDTH:
            b = np.r_[b, np.zeros(WIDTH - len(b), np.uint8)]
        m = self.blocks(b)
        p = np.maximum(np.maximum(m[:-1], m[1:]) if len(m) > 1 else m, 0)
        h = np.maximum(p @ self.net.hidden[:-1] + self.net.hidden[-1], 0)
        out = self.net.out
        return float(_sigmoid(h.mean(0) @ out[:HIDDEN] + h.max(0) @ out[HIDDEN:-1] + out[-1]))


def _scored(columns, net):
    scorer = Scorer(net.value)
    scores = [scorer.score(t) for t in columns["text"].to_pylist()]
    return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}


def _accepted(columns, net):
    scorer = Scorer(net.value)
    return [scorer.score(t or "") >= THRESHOLD for t in columns["text"].to_pylist()]


def accepted(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least THRESHOLD."""
    return filter_batches(docs, _accepted, docs.sparkSession.sparkContext.broadcast(net))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """A net from (doc_id, text) and (doc_id, quality): the ``sample`` labelled documents that come first by a hash of their id, as
    long as they have SAMPLE_BYTES together.

    Rows without text, id or a label of 0 or 1 are left out. Of labels that contradict each other the mean counts, 1 from a half on.
    The sample's texts are the only ones that reach the driver, whole.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    one = usable.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sampled = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # A repeated id counts once. One window over at most ``sample`` sizes.
    once = kept(sampled.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")
    so_far = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = once.select("doc_id", so_far.alias("bytes")).filter(F.col("bytes") <= SAMPLE_BYTES).select("doc_id")
    found = once.join(F.broadcast(fits), "doc_id").toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["text"].to_pylist(), found["quality"].to_pylist()))
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.float32))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of (doc_id, text, held_out).

    A null text counts as empty, and an empty one is scored as zero bytes. Repeated rows and null doc_ids give a row
    each; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = "doc_id bigint, held_out boolean, score double, predicted int"
    return by_batch(texts(docs, "held_out"), _scored, schema, shared)


def labelled(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: crc32 of doc_id is not 0 modulo 5."""
    return labels.select("doc_id", "quality").filter(remainder("doc_id", 5) != 0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of documents whose crc32 of doc_id is not 0 modulo 5, and score all of ``docs``."""
    rows = texts(docs).withColumn("held_out", remainder("doc_id", 5) == 0)
    return score(rows, learn(rows, labelled(labels)))
