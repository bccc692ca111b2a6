import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import spelling_trie as st

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(n):
    form, around = {}, {}
    for w in n:
        around[w] = [v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def edits(seed, stems, n):
    """Words with many near ones, and letters swapped so that leaves have several words."""
    r, letters, out = random.Random(seed), "abcdeéßñ", []
    stems = ["".join(r.choice(letters) for _ in range(r.randint(7, 10))) for _ in range(stems)]
    for _ in range(n):
        w = list(r.choice(stems))
        for _ in range(r.randint(0, 2)):
            i, kind = r.randrange(len(w)), r.random()
            if kind < 0.35:
                w[i] = r.choice(letters)
            elif kind < 0.6:
                del w[i]
            elif kind < 0.8:
                w.insert(i, r.choice(letters))
            else:
                j = r.randrange(len(w))
                w[i], w[j] = w[j], w[i]
        out.append("".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    supply = edits(1, 4, 4000)
    rows = [(i, " ".join(supply[i * 20 : i * 20 + 20])) for i in range(200)]
    rows += [(1000 + i, "abcdeabcd! ABCDEabcd abcdeabc7abcdeabc×abcdeabc " * 7) for i in range(40)]
    return rows + [(2000, "abcdeabcx abcdeabcx abcdeabbx abcdeabbx " * 3), (None, "abcdeabbb abcdeabbb ÀBCDEABCD àbcdeabcd àbcdeabcd")]


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as word", "1 as n", "2 as node", "3 as state").repartition(3)
    want = brute(counted(rows))
    assert len(want) > 150 and sum(w[1] is not None for w in want) > 20 and max(w[4] for w in want) > 4
    assert any(w[2] not in (w[0], w[1]) for w in want)  # a chain of forms
    assert rows_of(st.variants(df)) == want
    # Nodes that go down level by level, that no level can part, and fronts of a few searches.
    for name, value in (("NODE", 400), ("FRONT", 7), ("COMPARED", 50), ("COUNTED", 30), ("NODE", 20)):
        monkeypatch.setattr(st, name, value)
        if name != "FRONT":
            assert rows_of(st.variants(df)) == want


def test_one_edit():
    supply = sorted({w for w in edits(2, 3, 300) if len(w) >= 3})
    for a in supply[:80]:
        for b in supply:
            if a != b and len(a) - len(b) in (0, 1):
                x, y = (st._padded([w.encode("latin-1")], len(w)) for w in (a, b))
                assert bool(st.one_edit(x, y, len(b))[0]) == near(a, b), (a, b)


def test_pairs_are_found_once(monkeypatch):
    supply = sorted({w for w in edits(3, 4, 400) if len(w) == 8})
    longer = sorted({w for w in edits(3, 4, 400) if len(w) == 9})
    groups = st.letter_groups(np.bincount(np.frombuffer("".join(supply).encode("latin-1"), np.uint8), minlength=256))
    home, asked = [w.encode("latin-1") for w in supply], [w.encode("latin-1") for w in supply + longer]
    states = np.r_[np.full(len(supply), st.SAME), np.full(len(longer), st.OWED)]
    a, b = st.near_pairs(home, asked, states, groups, 0)
    got = list(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i, x in enumerate(supply + longer) for j, y in enumerate(supply) if near(x, y)}
    both = {frozenset((asked[i], home[j])) for i, j in want}
    assert len(got) == len(set(got)) == len(both) and {frozenset((asked[i], home[j])) for i, j in got} == both


def test_long_words_and_awkward_texts(spark, docs, awkward):
    long = "abcdefg" * 3000
    more = [(30, f"{long} {long} {long[:-1]} {long[:-1]} {long[1:]}x {long[1:]}x"), (31, long[:500] + "é" + long[501:]), (32, long[:500] + "é" + long[501:])]
    assert rows_of(st.variants(docs(awkward + more))) == brute(counted(awkward + more))


def test_empty(spark, docs):
    assert st.variants(docs([])).collect() == []
    assert st.variants(docs([(1, None), (2, ""), (3, "short words only")])).collect() == []


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = counted([(r.doc_id, r.text) for r in df.collect()])
    got = rows_of(st.variants(df))
    assert {(r[0], r[3]) for r in got} == set(want.items())
    some = sorted(want)[::40]
    found = {r[0]: r for r in got}
    for w in some:
        around = [v for v in want if abs(len(v) - len(w)) < 2 and near(v, w)]
        assert found[w][4] == len(around)
