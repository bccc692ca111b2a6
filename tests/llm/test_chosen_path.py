import re
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import chosen_path
from twinsieve.llm.chosen_path import Rule
from twinsieve.llm.graphs import components


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, rule):
    """(doc_id, n_shingles, component_id, kept) by comparing everything with everything."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t, rule.words))
    ids = sorted(sets)
    head = {d: d for d in ids}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and any(x and y and 100 * len(x & y) >= rule.percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                head[high] = low
    return Counter(
        (d, len(shingles(t, rule.words)), None if d is None else find(d), d is None or find(d) == d) for d, t in rows
    )


def near(words, n, changes, seed):
    out = words(n, seed)
    for k in range(changes):
        out[(k * 37 + seed) % n] = f"changed{seed}x{k}"
    return " ".join(out)


@pytest.fixture
def groups(words):
    base = words(200, 9)
    rows = [(50 + i, " ".join(words(150, i + 50))) for i in range(20)]
    for i in range(60):  # copies of one text with one to twelve words changed: some linked, some only through others, some not
        text = list(base)
        for k in range(1 + i % 12):
            text[(i * 53 + k * 29) % 200] = f"new{i}x{k}"
        rows.append((100 + i, " ".join(text)))
    rows += [(300 + i, " ".join(base).upper()) for i in range(5)]
    return rows


@pytest.mark.parametrize("rule", [Rule(3, 85), Rule(5, 80)])
def test_against_brute_force(docs, awkward, groups, rule):
    rows = awkward + groups
    assert Counter(map(tuple, chosen_path.near_duplicates(docs(rows), rule).collect())) == brute(rows, rule)


def test_crowded_nodes_and_blocks_give_the_same(docs, groups, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 1500)
    assert Counter(map(tuple, chosen_path.near_duplicates(docs(groups), Rule(3, 85)).collect())) == brute(groups, Rule(3, 85))


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = chosen_path.near_duplicates(df, Rule(3, 85)).collect()
    assert Counter(map(tuple, got)) == brute([(r.doc_id, r.text) for r in df.collect()], Rule(3, 85))


def test_one_of_each_group_stays(docs, awkward, groups):
    rows = awkward + groups
    left = chosen_path.without_near_duplicates(docs(rows), Rule(3, 85))
    want = Counter(d for (d, _, _, kept), n in brute(rows, Rule(3, 85)).items() for _ in range(n) if kept)
    assert Counter(r.doc_id for r in left.collect()) == want and left.columns == docs(rows).columns


def test_empty(docs):
    assert chosen_path.near_duplicates(docs([]), Rule(3, 85)).collect() == []


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 6000, n).astype(np.uint64)) for n in (0, 1, 50, 3000, 5000, 5000)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (np.maximum(chosen_path.intersections(sets), np.diag([len(s) for s in sets])) == want).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    head = {v: v for e in edges if e[0] != e[1] for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and head[a] != head[b]:
                head[a] = head[b] = min(head[a], head[b])
                changed = True
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert dict(map(tuple, got)) == head and len(got) == len(head)


def vectors(spark, group, strangers):
    """One group of a hundred points around 0 and others far apart, all under one key; a point in two is a bridge."""
    rows = [(1, i, i % 100) for i in range(group)] + [(1, 10_000 + i, 1_000 * (i + 1)) for i in range(strangers)]
    return spark.createDataFrame(rows, "k bigint, rep bigint, x int").repartition(3)


def near_by(met, most):
    """A compare function: points at most ``most`` apart are linked. Counts the rows it gets."""

    def compare(rows):
        rows = rows.localCheckpoint()
        met.append(rows.count())
        one, other = rows.alias("one"), rows.alias("other")
        pairs = one.join(other, "k").where(f"one.rep > other.rep and abs(one.x - other.x) <= {most}")
        return pairs.selectExpr("one.rep as a", "other.rep as b")

    return compare


def test_many_blocks_give_the_same(docs, groups, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "DIRECT", 1)
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", 1500)
    assert Counter(map(tuple, chosen_path.near_duplicates(docs(groups), Rule(3, 85)).collect())) == brute(groups, Rule(3, 85))


@pytest.mark.parametrize("most", [99, 50, 1])
def test_blocks_lose_no_component(spark, monkeypatch, most):
    monkeypatch.setattr(chosen_path, "LEAF", 10)
    from pyspark.sql import functions as F

    rows = vectors(spark, 130, 25)
    got = chosen_path.by_blocks(rows, "k", F.lit(0.1), near_by([], most))
    found = {r.vertex: r.component for r in components(got).collect()}
    assert found == {i: 0 for i in range(130)}  # points of the group are all reachable, strangers are not


def test_rows_of_like_members_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 10)
    from pyspark.sql import functions as F

    met = {}
    for group in (200, 400, 800):
        rows = vectors(spark, group, 0)
        components(chosen_path.by_blocks(rows, "k", F.lit(0.1), near_by(met.setdefault(group, []), 99))).count()
    assert all(sum(met[g]) <= 3 * g for g in met), met  # with all pairs of blocks: group * group / 10


def test_members_of_crowded_nodes_grow_in_proportion(spark, monkeypatch):
    """Rows over all levels for a group of near copies, twice as large: no more than twice as many, and no sketches among them."""
    monkeypatch.setattr(chosen_path, "LEAF", 20)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, chosen_path.COORDINATES, dtype=np.uint64).astype(np.uint32)
    made = []
    for group in (400, 800):
        sketches = [np.where(rng.random(chosen_path.COORDINATES) < 0.05, rng.integers(0, 1 << 32, chosen_path.COORDINATES), base).astype(np.uint32) for _ in range(group)]
        classes = spark.createDataFrame([(i, 100, s.tobytes()) for i, s in enumerate(sketches)], "rep bigint, n int, sketch binary")
        rate, crowded = 100 / 85 / chosen_path.COORDINATES, []
        for _ in range(chosen_path.LEVELS):
            share = spark.sparkContext.broadcast(list(crowded))
            sizes = chosen_path.sized(classes, range(chosen_path.TREES), rate, share).groupBy("node").sum("members").collect()
            crowded.append(np.sort(np.array([n for n, members in sizes if members > 20], np.int64)))
        share = spark.sparkContext.broadcast(crowded)
        parts = [chosen_path.branched(classes, range(chosen_path.TREES), rate, share, is_large) for is_large in (False, True)]
        assert all(p.columns == ["node", "rep", "n", "bits"] for p in parts)
        made.append([p.count() for p in parts])
    assert made[0][1] > 0 and sum(made[1]) <= 2.2 * sum(made[0]), made
