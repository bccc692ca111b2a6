import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinsieve.llm import syncmers


def read(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def edits(rows):
    """Edited texts in the defined order: descending id, nulls last, equal ids by text."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    return [(d, t, nxt, t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]) for (d, t), (_, nxt) in zip(order, order[1:] + order[:1])]


@pytest.mark.parametrize("per_range", [512, 2])
def test_edited_texts(docs, awkward, monkeypatch, per_range):
    monkeypatch.setattr(syncmers, "WINDOW_ROWS", per_range)
    rows = awkward + [(d, f"tail {d} " + "xyz " * (d % 9)) for d in range(1000, 1040)]
    got = sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in syncmers.edited_pairs(docs(rows)).collect())
    assert got == sorted((d or -1, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, _, e in edits(rows))


def test_likenesses(docs, words):
    rows = [(i, " ".join(words(120, i))) for i in range(1, 30)] + [(30, " ".join(words(120, 1))), (31, ""), (32, "")]
    got = {r.doc_id: r for r in syncmers.edited_pairs(docs(rows)).collect()}
    for r in got.values():
        for text in (r.fingerprint, r.edited_fingerprint):
            cut = [text[i : i + 8] for i in range(0, len(text), 8)]
            assert len(set(cut)) == len(cut)
    assert got[1].fingerprint == got[30].fingerprint != got[2].fingerprint and got[31].fingerprint == ""
    assert all(0.35 < got[i].near_edited < 0.65 and got[i].near_next < 0.05 for i in range(3, 30))
    assert got[32].near_edited == got[32].near_next == 1.0 and got[31].near_next == 0.0


def test_single_document_follows_itself(docs):
    (r,) = syncmers.edited_pairs(docs([(4, "one two three four five six")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"one two three four" + b"one two t").hexdigest()


def test_anchors_are_closed_syncmers(docs, words):
    text = " ".join(words(80, 5)) + " Ünïcode, 123456789012 日本語!"
    df = docs([(1, text)])
    hashes = df.select(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(syncmers.SYMBOL), 0), lambda s: F.xxhash64(s)).alias("h"))
    small = hashes.select(F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.xxhash64(F.col("h")[i], F.col("h")[i + 1])).alias("s")).first().s
    want = [i for i in range(len(small) - 3) if min(small[i : i + 4]) in (small[i], small[i + 3])]
    found = syncmers.fingerprints(df).first().anchors
    assert [a.position for a in found] == want and len(want) > 30


def test_short_and_empty(docs):
    got = read(syncmers.fingerprints(docs([(1, "a b"), (2, "a b"), (3, "a c"), (4, None), (5, " \n"), (5, "a b")])))
    assert got[1][0].anchors == got[2][0].anchors != got[3][0].anchors and len(got[1][0].anchors) == 1
    assert got[4][0].anchors == [] == min(r.anchors for r in got[5])
    assert syncmers.edited_pairs(docs([])).collect() == []
