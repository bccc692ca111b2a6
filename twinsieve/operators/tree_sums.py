"""Folder fingerprints kept between scans, and brought up to date by what has changed.

Everything a fingerprint is made of is a sum over lines: a folder's row here has those sums for its own files and sub folders.
A changed file takes its old line out of its folder's sums and puts the new one in; a folder whose fingerprint or
counts have changed by that does the same in the folder above it. So only folders with changes and those above them are read,
and where a change cancels out nothing goes further up.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent_of, tree_level
from ..session import Table, materialize
from .groups import lookup
from .hierarchy import LEVELS_PER_JOB, LIMBS, digest_of_sums, file_line, folder_line, folder_readable, limbs_of

# Of a folder: its lines' sums and number, files, folders and bytes of its tree, reasons why it is not provable, and
# whether it is catalogued. A folder that is not has a row while something below it is.
SUMS = [*LIMBS, "lines", "files", "folders", "bytes", "unproven", "own"]
TREE_SCHEMA = f"path string, level int, {', '.join(f'{c} bigint' for c in SUMS)}, fingerprint string"
_SEEN_ABOVE = ("fingerprint", "files", "folders", "bytes", "own")


class TreeUpdate(NamedTuple):
    """``touched``: the new rows of all folders with changes and those above, rows of gone folders with zero sums. ``scope``: their paths."""

    touched: Table
    scope: Table


def _row(**sums: Column | int) -> list[Column]:
    """All the sums; those not named are 0."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [value(sums.get(c, 0)).cast("bigint").alias(c) for c in SUMS]


def file_changes(files: DataFrame, sign: int = 1, with_md5: bool = False) -> DataFrame:
    """What ``files`` (metadata, with ``md5`` for content) add to their folders' sums, or with -1 take out of them."""
    line, complete = file_line(with_md5)
    lines = files.select(F.col("folder").alias("path"), "size_bytes", complete.alias("complete"), line.alias("line"))
    lines = lines.select("path", "size_bytes", "complete", *limbs_of("line"))
    return lines.select("path", *_row(
        **{limb: F.col(limb) * sign for limb in LIMBS}, lines=sign, files=sign,
        bytes=F.coalesce("size_bytes", F.lit(0)) * sign, unproven=(~F.col("complete")).cast("bigint") * sign,
    ))


def folder_changes(folders: DataFrame, sign: int = 1) -> DataFrame:
    """What it adds that ``folders`` are catalogued, or with -1 that they no longer are."""
    return folder_readable(folders).select("path", *_row(unproven=(~F.col("readable")).cast("bigint") * sign, own=sign))


def changed_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are gone, and rows that are new; a row whose columns have changed is both."""
    return before.exceptAll(after), after.exceptAll(before)


def update_tree(state: DataFrame | None, changes: DataFrame, implied: bool = False, levels_per_job: int = LEVELS_PER_JOB) -> TreeUpdate | None:
    """Bring the folders' rows up to date, deepest level first.

    ``state`` (TREE_SCHEMA) may leave out folders without changes in or below them; None stands for nothing at all.
    ``changes`` are rows of :func:`file_changes` and :func:`folder_changes`. With ``implied`` a folder is catalogued while there is a
    file below it, instead of by rows of its own. One shuffle per level, of touched folders only; every ``levels_per_job``
    levels the result is written. None if the changes cancel each other out.
    """
    summed = changes.groupBy("path").agg(*[F.sum(c).alias(c) for c in SUMS])
    some = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in SUMS])
    moved = materialize(
        summed.filter(some).withColumn("level", tree_level("path")).sortWithinPartitions("level"), "tree-changes",
        extremes="level", columnar=True,
    )
    if moved.rows == 0:
        return None
    above = moved.df.select(F.explode(ancestors("path")).alias("path")).distinct()
    scope = materialize(above.withColumn("level", tree_level("path")), "tree-scope", measure=["path"], extremes="level")
    scope = scope._replace(df=scope.df.select("path"))
    before = None
    if state is not None:
        held = lookup(state, scope, ["path"], ["path"]).sortWithinPartitions("level")
        before = materialize(held, "tree-before", columnar=True).df
    written: list[DataFrame] = []
    below: DataFrame | None = None
    rows = 0
    for deepest in range(moved.most, scope.least - 1, -levels_per_job):
        lowest = max(deepest - levels_per_job + 1, scope.least)
        batch = []
        for level in range(deepest, lowest - 1, -1):
            old = None if before is None else before.filter(F.col("level") == level)
            now = _updated_level(old, moved.df.filter(F.col("level") == level), below, implied).withColumn("level", F.lit(level))
            batch.append(now)
            below = _changes_above(now)
        table = materialize(reduce(DataFrame.unionByName, batch), "tree-sums")
        written.append(table.df)
        rows += table.rows
        below = _changes_above(table.df.filter(F.col("level") == lowest))
    touched = reduce(DataFrame.unionByName, written).select("path", "level", *SUMS, "fingerprint")
    return TreeUpdate(Table(touched, rows, 0), scope)


def _updated_level(old: DataFrame | None, moved: DataFrame, below: DataFrame | None, implied: bool) -> DataFrame:
    was = [f"was_{c}" for c in _SEEN_ABOVE]
    parts = [moved.select("path", *SUMS)] + ([] if below is None else [below])
    if old is not None:
        parts.append(old.select("path", *SUMS, *[F.col(c).alias(f"was_{c}") for c in _SEEN_ABOVE]))
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for c in set(was) - set(lines.columns):
        lines = lines.withColumn(c, F.lit(None).cast("string" if c == "was_fingerprint" else "bigint"))
    # There is at most one old row of a path.
    rows = lines.groupBy("path").agg(*[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in was])
    if implied:
        # As in an inventory's folders, what lies above all roots is none.
        rows = rows.withColumn("own", ((F.col("files") > 0) & (F.col("path") != "/")).cast("bigint"))
    provable = (F.col("own") > 0) & (F.col("unproven") == 0)
    return rows.withColumn("fingerprint", F.when(provable, digest_of_sums()))


def _changes_above(rows: DataFrame) -> DataFrame:
    """Old lines out of and new lines into the sums of the folders above, for rows that look different from there."""
    catalogued, was = F.col("own") > 0, F.coalesce(F.col("was_own") > 0, F.lit(False))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in _SEEN_ABOVE if c != "own"])
    seen = lambda sign, prefix="": F.struct(
        F.lit(sign).alias("sign"), *[F.col(prefix + c).alias(c) for c in _SEEN_ABOVE if c != "own"]
    )
    moved = rows.filter((catalogued | was) & ~(catalogued & was & same)).withColumn("parent", parent_of("path"))
    both = F.array_compact(F.array(F.when(catalogued, seen(1)), F.when(was, seen(-1, "was_"))))
    lines = moved.filter("parent <> path").select("path", "parent", F.explode(both).alias("x")).select("path", "parent", "x.*")
    lines = lines.withColumn("line", folder_line("fingerprint", "path")).select("*", *limbs_of("line"))
    sign = F.col("sign")
    return lines.select(F.col("parent").alias("path"), *_row(
        **{limb: F.col(limb) * sign for limb in LIMBS}, lines=sign, files=F.col("files") * sign,
        folders=(F.col("folders") + 1) * sign, bytes=F.col("bytes") * sign,
        unproven=F.col("fingerprint").isNull().cast("bigint") * sign,
    ))


def remaining(touched: DataFrame) -> DataFrame:
    """The touched rows that still stand for something."""
    return touched.filter("own > 0 or lines > 0")


def next_state(state: DataFrame | None, update: TreeUpdate | None) -> DataFrame:
    """All folders' rows after an update; rows out of its scope are taken over as they are."""
    if update is None:
        return state
    kept = remaining(update.touched.df)
    if state is None:
        return kept
    return lookup(state, update.scope, ["path"], ["path"], "left_anti").select(*kept.columns).unionByName(kept)


def fingerprints_in(state: DataFrame) -> DataFrame:
    """The catalogued folders in the columns of :func:`.hierarchy.fingerprint`."""
    return state.filter("own > 0").select(
        "path", "level", "fingerprint", F.col("files").alias("file_count"), F.col("folders").alias("folder_count"),
        F.col("bytes").alias("size_bytes"),
    )
