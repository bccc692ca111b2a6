"""Ranks inside hot groups and over whole tables, computed by many tasks."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import location_order
from .. import session
from ..session import materialize, partitions_for

# Slices in a block; up to so many, there are no blocks.
BLOCK_SLICES = 1024


def rank_sliced(rows: DataFrame, order: Sequence[Column], rank: str, group: Sequence[str] = ()) -> DataFrame:
    """Row number over the whole table, or within each group, for groups of any size.

    Rows are range-partitioned by (group, order) into even slices and written; a row's rank is
    its place in its slice plus the rows of its group in earlier slices. Only totals are accumulated
    in one task: those of one block's slices, and those of the blocks.
    """
    keys = [F.col(c) for c in group]
    source = materialize(rows, "to-rank", columnar=True)
    slices = partitions_for(rows.sparkSession, source.rows, session.HOT_GROUP_ROWS)
    sliced = source.df.repartitionByRange(slices, *keys, *order).withColumn("slice", F.spark_partition_id())
    written = materialize(sliced, "slices", columnar=True).df
    totals = written.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("slice_rows"))
    starts = _rows_before(totals, slices, group)
    place = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order))
    ranked = written.join(starts, [*group, "slice"])
    return ranked.withColumn(rank, (F.col("start") + place).cast("bigint")).drop("start", "slice")


def _rows_before(totals: DataFrame, slices: int, group: Sequence[str]) -> DataFrame:
    """(group, slice, start): the rows of each slice's group in earlier slices, from (group, slice, slice_rows)."""
    keys = [F.col(c) for c in group]

    def before(rows: str, order: str, *within: Column) -> Column:
        earlier = Window.partitionBy(*keys, *within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(rows).over(earlier), F.lit(0))

    if slices <= BLOCK_SLICES:
        return totals.select(*group, "slice", before("slice_rows", "slice", F.lit(0)).alias("start"))
    blocked = totals.withColumn("block", F.floor(F.col("slice") / F.lit(BLOCK_SLICES)))
    blocks = blocked.groupBy(*group, "block").agg(F.sum("slice_rows").alias("block_rows"))
    block_starts = blocks.select(*group, "block", before("block_rows", "block", F.lit(0)).alias("block_start"))
    inside = blocked.select(*group, "slice", "block", before("slice_rows", "slice", F.col("block")).alias("in_block"))
    found = inside.join(block_starts, [*group, "block"])
    return found.select(*group, "slice", (F.col("block_start") + F.col("in_block")).alias("start"))


def copy_rank(copies: DataFrame, widest: int | None, location: str = "folder") -> DataFrame:
    """Number the copies of each set (``pos``) by location: least nested first, then path order.

    ``copies`` has the set's size in ``copies``; ``widest`` is the largest of them, or None when it is
    not known. Ordinary sets are sorted by one task each; hot ones are ranked in slices.
    """
    order = [*location_order(location), F.col("path")]
    ranked = F.row_number().over(Window.partitionBy("set_id").orderBy(*order)).cast("bigint")
    is_hot = F.col("copies") > session.HOT_GROUP_ROWS
    if widest is not None and widest <= session.HOT_GROUP_ROWS:
        return copies.withColumn("pos", ranked)
    usual = copies.filter(~is_hot).withColumn("pos", ranked)
    return usual.unionByName(rank_sliced(copies.filter(is_hot), order, "pos", ["set_id"]))
