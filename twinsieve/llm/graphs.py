"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import kept


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex in (a, b); a component is named by its smallest vertex.

    Alternating large and small stars: each round hangs a vertex's larger neighbours on its smallest one, then its
    smaller ones, until nothing changes. Minima combine before the shuffle, and every round is written out.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(ordered, "edges", columnar=True)
    before = None
    while current.rows:
        found = current.df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if found == before:
            break
        before = found
        both = current.df.unionByName(current.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = kept(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lowest")
        large = kept(
            both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large-star"
        )
        least = kept(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = small.unionByName(least.withColumnRenamed("low", "b")).distinct()
        current = materialize(stars, "small-star", columnar=True)
    found = current.df.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "vertex")
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
