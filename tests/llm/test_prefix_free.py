import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from twinsieve.llm import prefix_free

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(CAPITALS)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = set()
    for lang in n:
        kept = []
        for (own, phrase), a in f.items():
            if own != lang or len(phrase) == 1 or a < least:
                continue
            around = [m for (other, p), m in f.items() if other == lang and len(p) == 3 and len(phrase) == 2 and phrase in (p[:2], p[1:]) and m >= least]
            if any(100 * m >= share * a for m in around):
                continue
            cuts = [(1000000 * a * a // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows(words):
    """Few different words, so that many phrases repeat, hot passages and every kind of separator."""
    supply = sorted(set(words(40, 5)))[:12]
    rows = []
    for i, seed in enumerate(range(11, 31)):
        flow = [supply[sum(w.encode()) % 12 if w != "anan" else 3] for w in words(150, seed)]
        marks = [" ", "\t", "  ", ". ", " , ", "\r\n", " ", " ", " ! ", " \x0b"]
        text = "".join(w.upper() if j % 7 == 0 else w + marks[(i * j + j) % 10] for j, w in enumerate(flow))
        rows.append((text, ["en", "fr", None][i % 3]))
    passage = "the quick brown Fox jumps over the lazy dog É é ß"
    return rows + [(passage, "en")] * 30 + [(passage, "de")] * 9 + [(passage + ". " + passage, "de")]


def test_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as phrase", "2 as n", "'x' as chunk", "3 as doc_id").repartition(5)
    for least, top, share in ((10, 2000, 50), (4, 7, 80)):
        got = prefix_free.collocations(df, least, top, share).collect()
        want = brute(rows, least, top, share)
        assert len(want) > 15 and len(got) == len(want)
        assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want


def test_routes_agree(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(map(tuple, prefix_free.collocations(df, 5).collect()))
    for name, value in (("HASHES", 0), ("HELD", 300), ("SCANNED", 40), ("TRIGGER", 1)):
        monkeypatch.setattr(prefix_free, name, value)
        assert sorted(map(tuple, prefix_free.collocations(df, 5).collect())) == want


def parse(text):
    _, found, behind = prefix_free.chunks(pa.array([text.encode()], pa.binary()))
    return [(c.split(), int(k)) for c, k in zip(found, behind)]


def test_chunks_own_each_word_once(words):
    for n in (0, 1, 2, 3, 10, 500):
        flow = words(n, n + 1)
        found = parse(" ".join(flow))
        assert [w.decode() for c, k in found for w in c[: len(c) - k]] == flow and all(k <= 2 for _, k in found)
    # Equal passages are cut equally, whatever stands around them.
    passage = " ".join(words(300, 9))
    inside = [{b" ".join(c) for c, _ in parse(text)} for text in (passage, "x " + passage + " y y y", passage + ". " + passage)]
    assert len(inside[0]) > 8 and len(inside[0] & inside[1] & inside[2]) >= len(inside[0]) - 2


def test_hashes_are_of_the_words_alone(words):
    flow = [*words(50, 2), "é" * 400, "é" * 399 + "e", "a", "aa", ""]
    texts = [" ".join(flow), "\n".join(reversed(flow)), *flow]
    data = "".join(texts).encode()
    bounds = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    found = prefix_free.scanned(np.frombuffer(data, np.uint8), bounds)
    of = {}
    for row, start, h in zip(found.row, found.start, found.hash):
        of.setdefault(texts[row].encode()[start:].split()[0], set()).add(int(h))
    assert set(of) == {w.encode() for w in flow if w} and all(len(x) == 1 for x in of.values())
    assert len({next(iter(x)) for x in of.values()}) == len(of)
    assert len(found.row) == 3 * (len(flow) - 1)


def test_bit_table_has_what_was_put_in():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    table = prefix_free.likely_of(h)
    assert table.has(h).all() and table.has(h + np.uint64(1 << 60)).mean() < 0.1
    assert not prefix_free.likely_of(h[:0]).has(h).any()


def test_bit_table_has_a_largest_size():
    h = np.random.default_rng(2).integers(0, 1 << 63, 12_000_000).astype(np.uint64) * np.uint64(2)
    table = prefix_free.likely_of(h)
    assert table.bits.nbytes == 32 << 20 and table.has(h).all() and table.has(h + np.uint64(1 << 60)).mean() < 0.1


def test_slices_make_the_same_bit_table(spark, rows, monkeypatch):
    h = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 2000)
    for hashes, width in ((h, 28), (h, 12), (h[:1], 28), (h[:0], 28)):
        monkeypatch.setattr(prefix_free, "WIDTH", width)
        want = prefix_free.likely_of(hashes.view(np.uint64))
        got = prefix_free.likely_among(spark.createDataFrame([(int(x),) for x in hashes], "h bigint").repartition(3), len(hashes))
        assert got.shift == want.shift and (got.bits == want.bits).all()
    # A table too small for its hashes lets more phrases through and changes no result.
    df = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(map(tuple, prefix_free.collocations(df, 5).collect()))
    monkeypatch.setattr(prefix_free, "WIDTH", 9)
    assert sorted(map(tuple, prefix_free.collocations(df, 5).collect())) == want


def test_tasks_hold_a_bounded_number_of_counts():
    """Chunks of 13 MB whose words are all different, so that every phrase is counted."""
    n, each = 40_000, 40
    flow = np.char.mod("%07x", np.arange(n * each)).reshape(n, each)
    chunks = [" ".join(x).encode() for x in flow.tolist()]
    rows = pa.RecordBatch.from_pydict({"lang": ["en"] * n, "chunk": pa.array(chunks, pa.binary()), "behind": pa.array([0] * n, pa.int32()), "n": pa.array([1] * n, pa.int64())})
    for make, counts in ((prefix_free._hash_counts, n * (2 * each - 1)), (prefix_free._phrase_counts(None), n * (4 * each - 3))):
        tracemalloc.start()
        total = most = 0
        for batch in prefix_free._by_held(make)(iter([rows])):
            total, most = total + pc.sum(batch["n"]).as_py(), max(most, batch.num_rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # Words, pairs and triples; _phrase_counts gives the sum of the words besides.
        assert total == counts and most <= 1 << 16 and peak < 150 << 20


def test_rows_are_cut_where_they_are_too_many(monkeypatch):
    monkeypatch.setattr(prefix_free, "HELD", 10)
    held = []

    def make(_, rows):
        held.append(rows["chunk"].to_pylist())
        return iter(())

    batches = [pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * len(c), pa.string()), "chunk": pa.array(c, pa.binary()), "behind": pa.array([0] * len(c), pa.int32()), "n": pa.array([1] * len(c), pa.int64())}) for c in (
        [b"aaaa", b"bbbb", b"cc", b"dd"], [], [b"e", b"f" * 30, b"g"])]
    assert not list(prefix_free._by_held(make)(iter(batches)))
    assert held == [[b"aaaa", b"bbbb", b"cc"], [b"dd", b"e"], [b"f" * 30], [b"g"]]


def test_repeated_passages_are_parsed_once(spark, words):
    passage = " ".join(words(400, 3))
    df = spark.createDataFrame([(passage, "en")] * 500, "text string, lang string")
    parsed = prefix_free.dictionary(df)
    one = prefix_free.dictionary(df.limit(1)).count()
    assert parsed.count() == one and {r.n for r in parsed.select("n").distinct().collect()} <= {500 * k for k in range(1, 40)}


def test_products_beyond_64_bits(spark):
    big = [(10**13 + 7, 3 * 10**14 + 1, 2 * 10**13 + 3), (10**9, 10**9, 10**9), (3, 5, 7)]
    df = spark.createDataFrame(big, "a bigint, l bigint, r bigint").select("*", prefix_free.cut_score("a", "l", "r").alias("score"))
    assert [r.score for r in df.collect()] == [1000000 * a * a // (l * r) for a, l, r in big]


def test_awkward(spark, docs, awkward):
    df = docs(awkward, {9: "en", 5: "", 10: "en"})
    rows = [(r.text, r.lang) for r in df.collect()]
    got = {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in prefix_free.collocations(df, 2, 50).collect()}
    assert got and got == brute(rows, 2, 50, 50)
    one = spark.createDataFrame([("a " * 50_000, "en"), ("b", "en")], "text string, lang string")
    assert [tuple(r) for r in prefix_free.collocations(one).collect()] == [("en", 1, "a a a", 49998, 50000, 49999, 50001, 999940)]


def test_empty(spark):
    assert prefix_free.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert prefix_free.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = prefix_free.collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    found = duckdb.sql(prefix_free.SQL)
    order = [found.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in found.fetchall())
