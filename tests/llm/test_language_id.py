import itertools
import zlib

import numpy as np
import pytest
from public_tokenizers import path

from twinsieve.llm import language_id

MODEL = path("piece_bpe_32k.model")


def cuts(word):
    for marks in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def brute(word, p):
    table = language_id.lattice(MODEL)
    total = np.zeros(p.shape[1])
    for cut in cuts("▁" + word):
        product = np.ones(p.shape[1])
        for part in cut:
            number = table.number.get(part, -1)
            if number < 0 and len(part) > 1:
                break
            product = product * p[number if number >= 0 else table.pieces]
        else:
            total += product
    return total


@pytest.fixture(scope="module")
def p():
    return np.random.default_rng(1).dirichlet(np.ones(language_id.lattice(MODEL).pieces + 1), 2).T


def test_all_segmentations_are_summed(p):
    words = ["the", "straße", "日本", "a", "queue", "zzzzzzzz", "ñandú", "ꙮx", "international"[:9]]
    got = language_id.word_probabilities(words, MODEL, p)
    assert np.allclose(got, [brute(w, p) for w in words], rtol=1e-9)


def test_forward_and_backward_meet(p):
    words = ["▁hello", "▁x", "▁straßenbahn"]
    lengths = np.array([len(w) for w in words])
    edges = language_id.lattice(MODEL).edges(words)
    weight = p[edges.piece, 0]
    alpha, beta = language_id.forward(lengths, edges, weight), language_id.backward(lengths, edges, weight)
    assert np.allclose(alpha[np.arange(3), lengths], beta[:, 0])


def test_training_raises_likelihood(spark, sf):
    df = language_id.learnable(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [r.text for r in df.filter("lang = 'en'").collect()]
    words = [w for t in texts for w in language_id.WORD.findall(t.lower())]

    def fit(rounds):
        m = language_id.train(df, MODEL, rounds)
        assert np.allclose(m.probability[:-1].sum(0), 1) and m.languages == ["de", "en", "es", "fr"]
        return np.log(language_id.word_probabilities(words, MODEL, m.probability)).sum(0)

    one, three = fit(1), fit(3)
    assert three[1] > one[1] and three.argmax() == 1


def test_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = language_id.identify(df, MODEL).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_awkward(docs, awkward):
    lang = {4: "en", 5: "en", 7: "de", 9: "en"}
    got = language_id.identify(docs(awkward, lang), MODEL).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r for r in got}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1, 2, 3, 8))
    assert by[9].lang_pred == by[5].lang_pred == "en" and 0 <= by[10].score <= 1 and by[10].lang_pred in ("en", "de")


def test_nothing_learnt_and_empty(docs):
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs([(3, "words")]), MODEL).collect()] == [("und", 0.0)]
    assert language_id.identify(docs([]), MODEL).collect() == []


def unseen_letters():
    """48 letters that are pieces by themselves only, and what they get from 1e10 pieces of five languages."""
    table = language_id.lattice(MODEL)
    letters = [n for n in table.number if len(n) == 1 and "一" <= n <= "鿿"][:48]
    word = "".join(letters)
    assert len(word) == 48 and len(table.edges(["▁" + word]).piece) == 49
    p = np.full((table.pieces + 1, 2), 1e-4)
    p[[table.number[c] for c in letters]] = 8e-19
    return word, letters, p


def test_words_below_underflow_have_logarithms():
    word, _, p = unseen_letters()
    got = language_id.word_logs([word, "hello"], MODEL, p)
    assert np.allclose(got[0], np.log(1e-4) + 48 * np.log(8e-19))
    assert np.allclose(got[1], np.log(language_id.word_probabilities(["hello"], MODEL, p)[0]))


def test_words_below_underflow_are_counted():
    word, _, p = unseen_letters()
    table = language_id.lattice(MODEL)
    marked = ["▁" + word, "▁hello"]
    lengths = np.array([49, 6])
    edges = table.edges(marked)
    got = language_id.shares(lengths, edges, p[edges.piece, 0])
    assert np.allclose(got[edges.word == 0], 1)
    alone = table.edges(marked[1:])
    assert np.allclose(got[edges.word == 1], language_id.shares(lengths[1:], alone, p[alone.piece, 0]))
    # The same in logarithms and in numbers.
    logs = np.log(p[alone.piece, 0])
    assert np.allclose(np.exp(language_id.log_forward(lengths[1:], alone, logs)), language_id.forward(lengths[1:], alone, np.exp(logs)))
    assert np.allclose(np.exp(language_id.log_backward(lengths[1:], alone, logs)), language_id.backward(lengths[1:], alone, np.exp(logs)))


def test_a_quote_of_unseen_letters_keeps_the_language(docs):
    word, _, p = unseen_letters()
    table = language_id.lattice(MODEL)
    p[table.edges(["▁hello"]).piece, 1] = 1e-2
    (r,) = language_id.predict(docs([(1, f"hello {word} hello")]).selectExpr("doc_id", "text", "true as held_out"), language_id.Model(["a", "b"], p), MODEL).collect()
    assert r.lang_pred == "b" and 0.9 < r.score <= 1
    assert language_id.accepted(docs([(1, f"hello {word}")]), language_id.Model(["a", "b"], p), MODEL, 0.5).count() == 1


def test_long_words_are_not_cut(p, docs):
    for word in ("hello" * 40, "straßenbahn" * 20):
        marked = "▁" + word
        table = language_id.lattice(MODEL)
        # Sum over all segmentations, place by place, in logarithms.
        for column in range(p.shape[1]):
            logs = [0.0] + [-np.inf] * len(marked)
            for end in range(1, len(marked) + 1):
                for start in range(max(0, end - 40), end):
                    piece = table.number.get(marked[start:end], table.pieces if end - start == 1 else None)
                    if piece is not None:
                        logs[end] = np.logaddexp(logs[end], logs[start] + np.log(p[piece, column]))
            assert language_id.word_logs([word, "x"], MODEL, p)[0, column] == pytest.approx(logs[-1], rel=1e-9)
    assert language_id.WORD.findall("a" * 5000 + " b") == ["a" * 5000, "b"]


def test_words_of_any_length_in_bounded_batches():
    lengths = np.array([3, 40_000, 9, 2, 9, 2_000_000] + [8] * 50_000)
    parts = list(language_id.by_length(lengths))
    assert sorted(np.concatenate(parts)) == list(range(len(lengths)))
    assert all(len(part) == 1 or len(part) * (lengths[part].max() + 1) <= language_id.CELLS for part in parts)
    assert max(map(len, parts)) <= language_id.BATCH and list(language_id.by_length(np.array([], np.int64))) == []
    word = "hello" * 8_000
    found = language_id.lattice(MODEL).edges(["▁" + word, "▁x"])
    assert found.end.max() == 40_001 and (np.diff(found.end) >= 0).all()
