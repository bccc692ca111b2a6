import math
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import kneser_ney as kn


def brute(train, numbers):
    """P(word | before) of both classes, worked out pair by pair."""
    of = [Counter(), Counter()]
    for text, toxic in train:
        words = [numbers.get(w, kn.UNKNOWN) for w in kn.LETTERS.findall(text.lower())]
        of[toxic].update(zip([kn.EDGE, *words], words))
    total, both = len(numbers) + 2, set(of[0]) | set(of[1])

    def p(k, before, word):
        shared = (sum(b == word for _, b in both) + 1) / (len(both) + total)
        once, twice = (sum(n == c for n in of[k].values()) for c in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        ahead = Counter(b for _, b in of[k])
        own = (max(ahead[word] - d, 0) + sum(min(n, d) for n in ahead.values()) * shared) / len(of[k]) if of[k] else shared
        uses = sum(n for (a, _), n in of[k].items() if a == before)
        if not uses:
            return own
        return (max(of[k][before, word] - d, 0) + d * sum(a == before for a, _ in of[k]) * own) / uses

    return of, p


@pytest.fixture(scope="module")
def train(words):
    supply = words(30, 6)
    return [(" ".join(supply[(i * j * j + j) % (20 + 5 * (i % 3))] for j in range(12)) + (" you moron" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(24)]


def test_models_against_brute_force(spark, train):
    seen = Counter(w for t, _ in train for w in kn.LETTERS.findall(t.lower()))
    numbers = {w: i + 2 for i, w in enumerate(sorted(w for w, n in seen.items() if n > 2))}
    assert len(numbers) < len(seen)
    c = kn.count(spark.createDataFrame(train, "text string, toxic int").repartition(3), numbers)
    of, p = brute(train, numbers)
    word, left, pair = kn.probabilities(c)
    assert {int(k): tuple(map(int, n)) for k, n in zip(c.pair, c.n.T)} == {a * c.total + b: (of[0][a, b], of[1][a, b]) for a, b in set(of[0]) | set(of[1]) if of[0][a, b] + of[1][a, b] > 1}
    for at, key in enumerate(c.pair):
        for k in (0, 1):
            assert pair[k, at] == pytest.approx(p(k, key // c.total, key % c.total))
    for before, after in [(kn.EDGE, kn.UNKNOWN), (5, 4), (3, 9)]:
        for k in (0, 1):
            if not of[k][before, after]:
                assert left[k][before] * word[k][after] == pytest.approx(p(k, before, after))
    for k in (0, 1):  # they are distributions
        assert sum(p(k, 4, w) for w in range(c.total)) == pytest.approx(1) and word[k].sum() == pytest.approx(1)


def test_evidence_of_tokens_and_features(spark, train):
    numbers = {w: i + 2 for i, w in enumerate(sorted({w for t, _ in train for w in kn.LETTERS.findall(t.lower())}))}
    e = kn.evidence(numbers, kn.count(spark.createDataFrame(train, "text string, toxic int"), numbers))
    of, p = brute(train, numbers)
    text = train[0][0] + " zzz " + train[4][0].upper()
    flow = [kn.EDGE, *(numbers.get(w, 0) for w in kn.LETTERS.findall(text.lower()))]
    keep = {(a, b) for a, b in set(of[0]) | set(of[1]) if of[0][a, b] + of[1][a, b] > 1}
    want = [math.log(p(1, a, b) / p(0, a, b)) for a, b in zip(flow, flow[1:])]
    got = kn.token_evidence(np.array(flow), e) / kn.UNIT
    for (a, b), x, y in zip(zip(flow, flow[1:]), got, want):
        # Bigrams seen once count as their backoff.
        if (a, b) in keep or not of[0][a, b] + of[1][a, b]:
            assert x == pytest.approx(y, abs=1e-5)
    x = np.clip(got, -kn.CAP, kn.CAP)
    window = max(sum(x[i : i + kn.WINDOW]) for i in range(len(x) - kn.WINDOW + 1)) / (kn.WINDOW + 2)
    strong = sum(max(v - kn.STRONG, 0) for v in x) / len(x)
    assert kn.features(text, e) == pytest.approx([x.mean(), window, math.log(strong + kn.LITTLE), math.log(len(x))], abs=1e-5)


def test_long_texts_go_in_pieces(spark, train, words, monkeypatch):
    numbers = {w: i + 2 for i, w in enumerate(sorted({w for t, _ in train for w in kn.LETTERS.findall(t.lower())}))}
    e = kn.evidence(numbers, kn.count(spark.createDataFrame(train, "text string, toxic int"), numbers))
    text = " ".join(words(3000, 2)) + " you moron " * 3
    want = kn.features(text, e)
    monkeypatch.setattr(kn, "PIECE", 1000)
    assert [w for part in kn.pieces(text) for w in part] == text.split()
    got = kn.features(text, e)
    assert got[[0, 2, 3]] == pytest.approx(want[[0, 2, 3]]) and got[1] <= want[1] + 1e-9
    assert "".join("".join(p) for p in kn.pieces("a" * 5000)) == "a" * 5000


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = kn.classify(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.9
    assert sum(p for p, y in held if not y) / sum(not y for _, y in held) < 0.02
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {}
    for r in got:
        scores.setdefault(texts[r.doc_id], set()).add(r.score)
    assert len(scores) < len(got) and all(len(s) == 1 for s in scores.values())


def test_awkward(spark, docs, awkward):
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 1), (5, 0), (9, 0), (9, 1), (7, None), (None, 1), (10, 0), (99, 1)], "doc_id bigint, toxic int").selectExpr("*", "1 as quality", "'x' as text")
    got = kn.classify(docs(awkward), labels).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    same = {r.doc_id: r.score for r in got}
    assert same[1] == same[2] == same[3] and same[4] == same[5]


def test_without_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r.score, r.predicted) for r in kn.classify(docs([(1, "x")]), none).collect()] == [(0.5, 1)]
    assert kn.classify(docs([]), none).collect() == []
