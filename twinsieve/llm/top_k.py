"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; a segment keeps its mean and the length of its deviation from it. Two segments of L
components then have a squared distance of at least L (m - m')^2 + (d - d')^2, which bounds the inner product
from above by L m m' + d d'. A block of candidates is bounded with few long segments first, what may still reach a
query's k-th best score with shorter ones next, and only the survivors' inner products are computed, in exact integers.

Queries are held by every task, a bounded number at a time; candidates stay where they are read. Each task keeps its
best k per query, and the winners of all tasks meet per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048  # candidates bounded together
QUERY_BYTES = 32 << 20  # queries broadcast at a time
SEGMENTS = (4, 16)  # coarse to fine


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """(vector, 2 x segments): mean times the root of the length, and length of the deviation."""
    parts = np.array_split(x.astype(np.float64), min(segments, x.shape[1]), axis=1) if x.shape[1] else []
    columns = []
    for part in parts:
        mean = part.mean(1)
        columns += [mean * part.shape[1] ** 0.5, np.sqrt(((part - mean[:, None]) ** 2).sum(1))]
    return np.stack(columns, 1) if columns else np.zeros((len(x), 0))


# Stands for a score below the range of 64 bits; an error if it is among a query's best.
TOO_LOW = np.iinfo(np.int64).min


def products(q: np.ndarray, c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Integer inner products of q's rows and c's, exactly, where ``counts`` says that a pair counts.

    Norms bound a product and all its partial sums, so each pair is worked out in the plainest arithmetic that is exact for it. A
    pair that counts and exceeds 64 bits is an error, since nothing else could push it out of its query's best.
    """
    bound = np.outer(*(np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (q, c))) * (1 + 1e-9)
    if bound.max(initial=0) < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    found = q @ c.T
    for i, j in zip(*np.nonzero((bound >= 2.0**63) & counts)):
        exact = sum(int(a) * int(b) for a, b in zip(q[i], c[j]))
        if exact > np.iinfo(np.int64).max:
            raise ArithmeticError("an inner product does not fit in 64 bits")
        found[i, j] = max(exact, TOO_LOW)
    return found


class Best:
    """Each query's best k so far, of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.levels = [features(x, s) for s in SEGMENTS]
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score
        self.query = np.zeros(0, np.int64)
        self.vector = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)

    def survivors(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that some query may want, and which queries those are."""
        left = np.arange(len(c))
        norm = np.sqrt((c.astype(np.float64) ** 2).sum(1))
        wanted = np.ones((len(self.ids), len(c)), bool)
        for own, segments in zip(self.levels, SEGMENTS):
            # The bound's rounding error is far below this slack.
            slack = 1e-9 * self.norm[:, None] * norm[left] + 1e-6
            bound = own @ features(c[left], segments).T + slack
            may = wanted[:, left] & (bound >= self.floor[:, None])
            wanted[:, left] = may
            left = left[may.any(0)]
        return left, wanted[:, left]

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        left, wanted = self.survivors(c)
        if not len(left):
            return
        ids = ids[left]
        wanted &= self.ids[:, None] != ids[None, :]
        found = products(self.x, c[left], wanted)
        wanted &= found >= self.floor[:, None]
        if wanted.shape[1] > self.k and len(np.unique(ids)) == len(ids):
            low = np.where(wanted, found, np.iinfo(np.int64).min)
            wanted &= found >= np.partition(low, -self.k, axis=1)[:, [-self.k]]
        q, at = np.nonzero(wanted)
        query, vector, score = np.r_[self.query, q], np.r_[self.vector, ids[at]], np.r_[self.score, found[q, at]]
        order = np.lexsort((-score, vector, query))  # one row per pair, the best
        query, vector, score = query[order], vector[order], score[order]
        first = np.r_[True, (query[1:] != query[:-1]) | (vector[1:] != vector[:-1])] if len(query) else np.zeros(0, bool)
        query, vector, score = query[first], vector[first], score[first]
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        self.query, self.vector, self.score = query[best], vector[best], score[best]
        last = place[best] == self.k - 1
        self.floor[self.query[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": pa.array(self.ids[self.query]), "vec_id": pa.array(self.vector), "score": pa.array(self.score)})


def scaled(vectors: DataFrame, factor: int) -> DataFrame:
    """(vec_id, x): components as floor(factor x); rows without id or with a null or non-finite component go."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(whole, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(whole, lambda x: F.floor(x * factor)).alias("x"))


def _by_length(ids: np.ndarray, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = lists.value_lengths().to_numpy()
    for length in np.unique(lengths):
        which = np.flatnonzero(lengths == length)
        yield int(length), ids[which], lists.take(pa.array(which)).flatten().to_numpy().reshape(len(which), length)


def _searched(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {length: Best(ids, x, k) for length, ids, x in queries.value}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for length, ids, x in _by_length(part["vec_id"].to_numpy(), part["x"]):
                    if length in best:
                        best[length].add(ids, x)
        for one in best.values():
            yield one.rows()

    return run


def search(vectors: DataFrame, is_query, k: int, factor: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows; ties go to the smaller vec_id.

    Vectors are compared with those of their own length. Rows that repeat a vec_id are one vector; where their
    components differ, the best score counts. Null vectors, and those with null or non-finite components, take no part, nor do
    null vec_ids. A query without any partner has no row; an empty table gives an empty one. Columns
    other than vec_id and embedding are not looked at. A best score outside 64 bits is an error.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors.select("vec_id", "embedding"), factor)
    asked = rows.filter(is_query)
    total = asked.agg(F.sum(F.size("x") * 8 + 8)).first()[0] or 0
    waves = max(1, -(-total // QUERY_BYTES))
    found = None
    for wave in range(waves):
        table = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave).toArrow()
        queries = list(_by_length(table["vec_id"].to_numpy(), table["x"].combine_chunks())) if table.num_rows else []
        part = rows.mapInArrow(_searched(spark.sparkContext.broadcast(queries), k), "query_id bigint, vec_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    pairs = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    fits = F.when(F.col("score") == F.lit(int(TOO_LOW)), F.raise_error(F.lit("an inner product does not fit in 64 bits")).cast("bigint")).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", fits.alias("score"))


def search_hundredths(vectors: DataFrame) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 100."""
    return search(vectors, F.col("vec_id") % 100 == 0, 10)


SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 10"""
