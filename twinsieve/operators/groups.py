"""Keeping and joining groups without sending a hot group to one task.

Every join here first measures its smaller side. A side of checked size is broadcast, and the rows
are not shuffled at all. Beyond that both sides are shuffled by key, and rows of hot keys are
spread over several partitions.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..session import Table, materialize, small


def group_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count per key; partial aggregation leaves one row per key and task to shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))


def measured_groups(groups: DataFrame) -> Table:
    """Groups (one row per key, with ``group_rows``) with their bytes and the largest count."""
    return materialize(groups, "groups", measure=groups.columns, extremes="group_rows")


def join_groups(
    rows: DataFrame,
    groups: DataFrame | Table,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left_semi",
    total: int | None = None,
) -> DataFrame:
    """Join rows to ``groups``; ``spread_by`` columns tell the rows of one key apart.

    ``total`` is the number of rows where it is known: too few rows for any key to be hot need no
    measuring.
    """
    if few(total):
        return rows.join(groups.df if isinstance(groups, Table) else groups, list(keys), how)
    table = groups if isinstance(groups, Table) else measured_groups(groups)
    if small(table):
        return rows.join(F.broadcast(table.df), list(keys), how)
    if table.most <= session.HOT_GROUP_ROWS:
        return rows.join(table.df, list(keys), how)
    hot = table.df.filter(F.col("group_rows") > session.HOT_GROUP_ROWS).select(*keys)
    return _salted(rows, table.df, hot, keys, spread_by, how)


def keep_repeated(
    rows: DataFrame, keys: Sequence[str], spread_by: Sequence[str], total: int | None = None
) -> DataFrame:
    """Rows whose key occurs more than once."""
    groups = group_counts(rows, keys).filter("group_rows > 1")
    return join_groups(rows, groups, keys, spread_by, "left_semi", total)


def lookup(
    rows: DataFrame,
    unique: DataFrame | Table,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left_semi",
    total: int | None = None,
) -> DataFrame:
    """Join rows to a relation with one row per key.

    When it is too large to broadcast, the hot keys are found by one partially aggregated pass over
    the key columns of ``rows``.
    """
    if few(total):
        return rows.join(unique.df if isinstance(unique, Table) else unique, list(keys), how)
    table = unique if isinstance(unique, Table) else materialize(unique, "lookup", measure=unique.columns)
    if small(table):
        return rows.join(F.broadcast(table.df), list(keys), how)
    hot = group_counts(rows, keys).filter(F.col("group_rows") > session.HOT_GROUP_ROWS).select(*keys)
    return _salted(rows, table.df, hot, keys, spread_by, how)


def few(total: int | None) -> bool:
    """Whether so few rows are known to be there that no key can be hot."""
    return total is not None and total <= session.HOT_GROUP_ROWS


def _salted(
    rows: DataFrame, unique: DataFrame, hot: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str
) -> DataFrame:
    """Spread rows of hot keys over SALTS partitions; repeat the key's single row for each.

    There is at most one hot key for every HOT_GROUP_ROWS input rows; their list is broadcast if its measured size allows.
    """
    salts = session.SALTS
    table = materialize(hot, "hot-keys", measure=list(keys))
    marked = table.df.select(*keys, F.lit(True).alias("is_hot"))
    marked = F.broadcast(marked) if small(table) else marked
    own = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(marked, list(keys), "left").withColumn("salt", own).drop("is_hot")
    right = unique.join(marked, list(keys), "left").withColumn("salt", F.explode(every)).drop("is_hot")
    return left.join(right, [*keys, "salt"], how).drop("salt")


def group_id(*parts: Column | str) -> Column:
    """Identifier of a group: a hash of its key, so it needs no numbering pass."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)
