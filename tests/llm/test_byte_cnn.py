import zlib

import numpy as np
import pytest

from twinsieve.llm import byte_cnn
from twinsieve.llm.byte_cnn import BLOCK, FILTERS, HIDDEN, WIDTH


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(5)
    return byte_cnn.Net(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32),
        rng.normal(0, 0.3, 2 * HIDDEN + 1).astype(np.float32),
    )


def brute(text, net):
    """Place by place, chunk by chunk."""
    b = text.encode().ljust(WIDTH, b"\0")
    responses = [sum(net.taps[j, b[t + j]].astype(float) for j in range(WIDTH)) for t in range(len(b) - WIDTH + 1)]
    blocks = [responses[i : i + BLOCK] for i in range(0, len(responses), BLOCK)]
    chunks = [blocks[i] + blocks[i + 1] for i in range(len(blocks) - 1)] or [blocks[0]]
    hidden = []
    for chunk in chunks:
        pooled = np.maximum(np.max(chunk, 0), 0)
        hidden.append(np.maximum(pooled @ net.hidden[:-1] + net.hidden[-1], 0))
    z = np.mean(hidden, 0) @ net.out[:HIDDEN] + np.max(hidden, 0) @ net.out[HIDDEN:-1] + net.out[-1]
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("n", [0, 1, WIDTH, BLOCK, BLOCK + WIDTH, 3 * BLOCK + 7])
def test_scores_cover_every_byte(words, net, n):
    text = " ".join(words(n, 3))[:n]
    assert abs(byte_cnn.Scorer(net).score(text) - brute(text, net)) < 1e-4
    if n > BLOCK:  # a loud end is heard
        assert byte_cnn.Scorer(net).score(text + "!!!! $$$$ ####") != byte_cnn.Scorer(net).score(text)


def test_long_texts_go_piece_by_piece(words, net, monkeypatch):
    text = " ".join(words(2000, 8))
    want = byte_cnn.Scorer(net).score(text)
    monkeypatch.setattr(byte_cnn, "PIECE", 3 * BLOCK)
    assert byte_cnn.Scorer(net).score(text) == pytest.approx(want, abs=1e-6)


def all_chunks(text):
    return byte_cnn.training_chunks(byte_cnn.training_bytes(text))


def test_long_texts_are_learnt_from_whole(words, net, monkeypatch):
    text = " ".join(words(3000, 4))
    x = all_chunks(text)
    m = byte_cnn.Scorer(net).blocks(np.frombuffer(text.encode(), np.uint8))
    assert len(x) == len(m) - 1 > 200
    pooled, at = byte_cnn._pooled(net.taps, x)
    assert np.allclose(np.maximum(pooled, 0), np.maximum(np.maximum(m[:-1], m[1:]), 0), atol=1e-5)
    monkeypatch.setattr(byte_cnn, "CHUNKS", 7)
    again = byte_cnn._pooled(net.taps, x)
    assert (again[0] == pooled).all() and (again[1] == at).all()


def test_the_sample_is_bounded_in_bytes_by_whole_texts(spark, docs, words, monkeypatch):
    seen = []
    monkeypatch.setattr(byte_cnn, "train", lambda documents, labels: seen.append(documents))
    texts = {i: " ".join(words(20, i)) for i in range(1, 9)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, quality int")
    byte_cnn.learn(docs(list(texts.items())), labels)
    monkeypatch.setattr(byte_cnn, "SAMPLE_BYTES", sum(map(len, texts.values())) // 2)
    byte_cnn.learn(docs(list(texts.items())), labels)
    assert seen[0] == list(texts.values()) and 0 < len(seen[1]) < 8 and set(seen[1]) < set(seen[0])
    assert sum(len(t.encode()) for t in seen[1]) <= byte_cnn.SAMPLE_BYTES


def test_training_chunks_agree_with_scoring(words, net):
    for n in (3, 200, 900):
        text = " ".join(words(n, 2))
        pooled = np.maximum(byte_cnn._pooled(net.taps, all_chunks(text)[:1])[0], 0)
        m = byte_cnn.Scorer(net).blocks(np.frombuffer(text.encode(), np.uint8))
        assert np.allclose(pooled[0], np.maximum(m[:2].max(0), 0), atol=1e-5)


def test_gradients(words):
    rng = np.random.default_rng(6)
    params = [
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)), rng.normal(0, 0.3, 2 * HIDDEN + 1),
    ]
    chunks = [all_chunks(" ".join(words(n, n))) for n in (10, 120, 60)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss(p):
        total = 0.0
        for c, y in zip(chunks, labels):
            raw, _ = byte_cnn._pooled(p[0], c)
            h = np.maximum(np.maximum(raw, 0) @ p[1][:-1] + p[1][-1], 0)
            z = h.mean(0) @ p[2][:HIDDEN] + h.max(0) @ p[2][HIDDEN:-1] + p[2][-1]
            total += np.log1p(np.exp(-z)) if y else np.log1p(np.exp(z))
        return total / 3

    grads = byte_cnn._gradients(params, chunks, labels)
    for k, place in [(0, (2, ord("t"), 3)), (0, (0, ord(" "), 1)), (1, (4, 5)), (1, (FILTERS, 2)), (2, (3,)), (2, (HIDDEN + 1,)), (2, (2 * HIDDEN,))]:
        moved = [p.copy() for p in params]
        moved[k][place] += 1e-5
        assert (loss(moved) - loss(params)) / 1e-5 == pytest.approx(float(grads[k][place]), abs=2e-4)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    got = byte_cnn.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.98


def test_awkward(spark, docs, awkward):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 1), (5, 0), (9, 0), (9, 1), (7, None), (None, 1), (10, 0), (99, 1)], "doc_id bigint, quality int").selectExpr("*", "1 as toxic", "'x' as text")
    got = byte_cnn.classify(docs(awkward), labels).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    same = {r.doc_id: r.score for r in got}
    assert same[1] == same[2] and same[4] == same[5]
    net = byte_cnn.learn(docs(awkward), byte_cnn.labelled(labels))
    assert {r.doc_id for r in byte_cnn.accepted(docs(awkward), net).collect()} <= {d for d, _ in awkward}


def test_without_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [(r.score, r.predicted) for r in byte_cnn.classify(docs([(1, "x")]), none).collect()] == [(0.5, 1)]
    assert byte_cnn.classify(docs([]), none).collect() == []
