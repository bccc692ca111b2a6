import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import brown


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def check_base(rows, got):
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        own = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert Counter(want) == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


@pytest.mark.parametrize("chunk", [brown.CHUNK_BYTES, 700])
def test_counts_and_base_scores(docs, awkward, monkeypatch, chunk):
    monkeypatch.setattr(brown, "CHUNK_BYTES", chunk)
    rows = awkward + [(d, f"The number {d % 5} of THE many Ärger") for d in range(100, 140)]
    got = brown.score_split(docs(rows)).collect()
    check_base(rows, got)
    assert all(math.isfinite(r.score) and r.score <= 0 and r.perplexity >= 1 for r in got)


def test_beats_unigrams_on_held_out_texts(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    got = brown.score_split(df).collect()
    check_base([(r.doc_id, r.text) for r in df.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_no_training_rows_and_empty(docs):
    only = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    (r,) = brown.score_split(docs([(only, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
    assert brown.score_split(docs([])).collect() == []


def small_model():
    rng = np.random.default_rng(3)
    vocabulary = [b"w%d" % i for i in range(40)]
    text = [vocabulary[i] for i in (rng.zipf(1.6, 3000) % 40)]
    counts = Counter(text)
    frequent = {w: i for i, (w, _) in enumerate(counts.most_common(10))}
    units = brown.Units(frequent)
    flow = [brown.END, *[units[w] for w in text], brown.END]
    bigrams = np.zeros((brown.END + 1, brown.END + 1))
    np.add.at(bigrams, (flow[:-1], flow[1:]), 1)
    n, once = np.zeros(brown.END + 1), np.zeros(brown.END + 1)
    for w, c in counts.items():
        n[units[w]] += c
        once[units[w]] += c == 1
    n[brown.END] = 1
    return counts, bigrams, brown.model_of(frequent, bigrams, n, once, len(counts) + 1)


def test_probabilities_sum_to_one():
    counts, _, m = small_model()
    assert np.allclose((10**m.transition).sum(1), 1)
    words = list(counts)
    _, cls, emission, _ = brown.word_columns(words, np.array([counts[w] for w in words]), m)
    mass = np.bincount(cls, 10.0**emission, brown.CLASSES + 1) + np.where(np.arange(brown.CLASSES + 1) < brown.CLASSES, m.unseen, 0)
    used = m.total > 0
    assert np.allclose(mass[used], 1)


def test_exchange_only_gains(monkeypatch):
    _, bigrams, _ = small_model()
    monkeypatch.setattr(brown, "CLASSES", 6)
    before = [brown.likelihood(bigrams, brown.exchange(bigrams, sweeps)) for sweeps in range(4)]
    assert before == sorted(before) and before[1] > before[0]
    # No single move helps any more, checked by computing the likelihood anew.
    of = brown.exchange(bigrams, 50)
    best = brown.likelihood(bigrams, of)
    for w in np.flatnonzero(bigrams.sum(1) + bigrams.sum(0)):
        if w != brown.END:
            for c in range(6):
                other = of.copy()
                other[w] = c
                assert brown.likelihood(bigrams, other) <= best + 1e-6


def test_best_classes_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    size, n_words = brown.CLASSES + 1, 30
    cls = rng.integers(0, 5, n_words)
    # Words on even places have classes of their own, so that no neighbour shares a word's class or moves with it.
    flow = np.empty(400, np.int64)
    flow[0::2], flow[1::2] = rng.integers(0, 15, 200), rng.integers(15, 30, 200)
    cls[15:] = 10 + cls[15:]
    path = np.r_[brown.CLASSES, cls[flow], brown.CLASSES]

    def table_of(path):
        return np.bincount(path[:-1] * size + path[1:], minlength=size * size).reshape(size, size).astype(float)

    table = table_of(path)
    words = np.unique(flow)
    entries = Counter()
    for i, w in enumerate(flow):
        at = int(np.searchsorted(words, w))
        entries[at, path[i]] += 1
        entries[at, size + path[i + 2]] += 1
    word, key = (np.array(x) for x in zip(*sorted(entries)))
    n = np.array([entries[e] for e in sorted(entries)])
    got = brown.best_classes(table, cls[words], np.bincount(flow)[words], word, key, n)
    for w, new in zip(words, got):
        def moved(c):
            return brown.likelihood(table_of(np.r_[brown.CLASSES, np.where(flow == w, c, cls[flow]), brown.CLASSES]), np.arange(size))

        strange = {10, 11, 12, 13, 14} if w < 15 else {0, 1, 2, 3, 4}
        if new not in strange:
            assert moved(new) >= max(moved(c) for c in range(brown.CLASSES) if c not in strange) - 1e-6


def test_rare_words_get_the_class_of_their_neighbours(docs, monkeypatch):
    """Words that share a suffix unit, but stand in the places of h and of k, get two classes."""
    asked = []
    whole = brown.word_classes
    monkeypatch.setattr(brown, "word_classes", lambda *a: asked.append(whole(*a)) or asked[-1])
    rows = [(d, f"a w{d // 2 % 40}xyz b v{d // 2 % 40}xyz c d" if d % 2 else "a h b k c d") for d in range(800)]
    # These fill the places of frequent words.
    rows += [(d, " ".join(f"f{i}" for i in range(1100))) for d in range(800, 830)]
    got = brown.score_split(docs(rows)).collect()
    assert len(got) == 830
    check_base(rows, got)
    known, table, once = asked[0]
    of = {bytes(r.word): r.cls for r in known.distinct().collect()}
    left, right = ({of[b"%c%dxyz" % (kind, i)] for i in range(40)} for kind in b"wv")
    assert not left & right
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    want = Counter()
    for t in train:
        path = [brown.CLASSES, *[of[w] for w in tokens(t)], brown.CLASSES]
        want.update(zip(path, path[1:]))
    assert {(i, j): table[i, j] for i, j in zip(*np.nonzero(table))} == want


def test_large_counts_are_given_in_parts():
    n, bounds = np.array([1, 255, 256, 1000, 510, 3]), np.array([0, 0, 2, 5, 6])
    keys, small, cut = brown._in_bytes(np.array([7, 8, 9, 10, 11, 12], np.uint8), n, bounds)
    assert small.max() <= 255 and small.min() >= 1
    assert {k: int(small[keys == k].sum()) for k in keys.tolist()} == dict(zip([7, 8, 9, 10, 11, 12], n.tolist()))
    assert [keys[a:b].tolist() for a, b in zip(cut, cut[1:])] == [[], [7, 8], [9, 9, 10, 10, 10, 10, 11, 11], [12]]
    assert [x.tolist() for x in brown._in_bytes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.array([0, 0]))] == [[], [], [0, 0]]


def test_chunks_and_buckets_exchange_packed_rows(docs, monkeypatch, words):
    """A chunk and a bucket tell each other a row, however many words they share; and what a text scores does not depend on them."""
    rows = [(d, " ".join([f"w{d % 7}x{i % 90}" for i in range(d, d + 150)] + words(40, d))) for d in range(60)]
    # These fill the places of frequent words, and more words are as frequent as the last of them.
    rows += [(d, " ".join(f"f{i}" for i in range(1100))) for d in range(60, 90)]
    whole = {r.doc_id: r for r in brown.score_split(docs(rows)).collect()}
    written, keep = [], brown.kept

    def kept(df, label):
        out = keep(df, label)
        if label in ("neighbours", "word-classes"):
            chunks, rows = {r.chunk for r in out.select("chunk").collect()} - {None}, out.count()
            written.append((len(chunks), rows))
        return out

    monkeypatch.setattr(brown, "kept", kept)
    monkeypatch.setattr(brown, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(brown, "BUCKET_BYTES", 60_000, raising=False)
    got = brown.score_split(docs(rows)).collect()
    check_base(rows, got)
    buckets = sum(len(t) for _, t in rows) // 60_000 + 1
    assert len(written) == 2 * brown.WORD_SWEEPS and buckets > 3
    assert all(0 < n <= chunks * (buckets + 1) for chunks, n in written)
    for r in got:
        assert r.n_known == whole[r.doc_id].n_known and math.isclose(r.score, whole[r.doc_id].score, abs_tol=1e-6)


@pytest.mark.parametrize("kind", ["<u1", "<i2", "<i4", "<i8"])
def test_packed_numbers_come_back(kind):
    top = np.iinfo(kind).max
    for numbers in ([], [0], [1, top, 0, top - 1, 77]):
        assert brown.unpacked(brown.packed(np.array(numbers, np.int64), kind), kind).tolist() == numbers
