import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from twinsieve.llm import sentencepieces

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_equals_library(docs, awkward, library):
    got = sentencepieces.round_trip_digests(docs(awkward), MODEL).collect()
    want = []
    for d, t in awkward:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
    assert Counter(map(tuple, got)) == Counter(want)


def test_encode_and_decode_give_ids_and_texts(docs, awkward, library):
    encoded = sentencepieces.encode(docs(awkward), MODEL)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((d, tuple(library.encode(t or ""))) for d, t in awkward)
    decoded = sentencepieces.decode(encoded, MODEL)
    assert Counter(map(tuple, decoded.collect())) == Counter((d, library.decode(library.encode(t or ""))) for d, t in awkward)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("▁ \nabtheinÀé日<s>/0x"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_agenda_on_any_text(text):
    library = sentencepieces.pieces(MODEL).library
    (ids,), (agreed,) = sentencepieces.pieces(MODEL).encode([text])
    assert agreed and ids == library.encode(text)
    assert sentencepieces.pieces(MODEL).decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 270)), max_size=12))
def test_decode_any_ids(ids):
    assert sentencepieces.pieces(MODEL).decode(ids) == sentencepieces.pieces(MODEL).library.decode(ids)


def test_empty_table(docs):
    assert sentencepieces.round_trip_digests(docs([]), MODEL).collect() == []
