import math

import duckdb
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import top_k


def brute(rows, is_query, k=10):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    scaled = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    best = {}
    for q, a in scaled:
        if is_query(q):
            for i, b in scaled:
                if i != q and len(a) == len(b):
                    s = sum(x * y for x, y in zip(a, b))
                    best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, s))
    out = set()
    for q, found in best.items():
        for rank, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


def test_awkward_vectors(spark):
    rows = [
        (0, [0.5, -0.25]), (100, [0.5, -0.25]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (200, [1.0]), (7, []), (300, []), (None, [1.0, 1.0]), (8, [-0.0001, 3.0]), (400, [0.1, 0.2, 0.3]), (9, [1e4, -1e4]),
    ]
    rows += [(1000 + i, [math.sin(i), math.cos(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'clash' as x", "1 as score", "2 as rank", "3 as query_id")
    rounded = [(r.vec_id, r.embedding) for r in df.collect()]
    got = top_k.search_hundredths(df).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rounded, lambda q: q % 100 == 0)


def test_large_components_are_exact(spark):
    rows = [(i, [float(2 ** (18 + i % 3)), 3.0 + i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = top_k.search(df, F.col("vec_id") % 7 == 0, 4).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, lambda q: q % 7 == 0, 4)


def test_only_scores_that_count_may_not_overflow(spark):
    big = float(2**22)

    def run(rows, k):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        return sorted(map(tuple, top_k.search(df, F.col("vec_id") == 0, k).collect()))

    # The query's own square needs 65 bits, and so does the third's score, which is not among the best.
    assert run([(0, [big, 0.0]), (1, [0.0, big]), (2, [1.0, 0.0]), (3, [-big, 1.0])], 2) == [(0, 1, 2, 2**42), (0, 2, 1, 0)]
    for rows, k in (([(0, [big, 0.0]), (1, [big, 0.0])], 1), ([(0, [big, 0.0]), (3, [-big, 1.0])], 2)):
        with pytest.raises(Exception, match="64 bits"):
            run(rows, k)


def test_waves_and_blocks_change_nothing(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(map(tuple, top_k.search(df, F.col("vec_id") % 5 == 0, 10).collect()))
    monkeypatch.setattr(top_k, "QUERY_BYTES", 10_000)
    monkeypatch.setattr(top_k, "BLOCK", 37)
    assert sorted(map(tuple, top_k.search(df, F.col("vec_id") % 5 == 0, 10).collect())) == want
    assert set(want) == brute([(r.vec_id, r.embedding) for r in df.collect()], lambda q: q % 5 == 0)


def test_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = top_k.search_hundredths(spark.read.parquet(f"{sf}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(top_k.SQL).fetchall())


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k.search_hundredths(df).collect() == []
