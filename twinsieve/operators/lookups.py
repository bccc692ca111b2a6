"""Matching recorded copies with a current catalog."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_key, sort_key
from ..functions.paths import ancestors, plain_folder
from ..functions.times import same_saved_date
from ..session import Table, materialize, small
from .groups import lookup

# Levels of roots that are looked up one by one.
ROOT_LEVELS = 16

PRESENT, MISSING, CHANGED, UNAVAILABLE = "Present", "Missing", "Changed", "Unavailable"


def measured_roots(roots: DataFrame) -> Table:
    """One row per root, unreachable if any of its rows is, with its ``level``; their bytes and extreme levels.

    Separators at the end do not matter, but for a root that is nothing else; rows without a root are left out.
    """
    plain = roots.filter("root is not null").select(plain_folder("root").alias("root"), "reachable")
    ranked = plain.groupBy("root").agg(F.bool_and("reachable").alias("reachable"))
    return materialize(ranked.withColumn("level", F.size(ancestors("root"))), "roots", measure=["root"], extremes="level")


def root_of_path(rows: DataFrame, roots: DataFrame | Table, path: str = "path") -> DataFrame:
    """Add ``root`` and ``reachable``: the longest root that a path is or lies below, if any.

    A path's roots are among its own ancestors, each at the place it has among its own. Roots of measured size are
    broadcast, those of each level as a table of their own in which the path's ancestor of that level is looked up; rows
    are not shuffled. Beyond that, or with roots over more than ROOT_LEVELS levels, different paths are joined with the roots by
    all their ancestors.
    """
    table = roots if isinstance(roots, Table) else measured_roots(roots)
    # The extremes were observed when the roots were written: no job is needed to know the levels.
    levels = range(table.least or 0, (table.most or 0) + 1) if table.rows else range(0)
    if small(table) and len(levels) <= ROOT_LEVELS:
        return _root_by_level(rows, table.df, levels, path)
    lines = rows.select(path).distinct().select(path, F.explode(ancestors(path)).alias("root"))
    held = lookup(lines, table, ["root"], [path], "inner")
    longest = F.max_by(F.struct("root", "reachable"), F.octet_length("root"))
    best = held.groupBy(path).agg(longest.alias("best"))
    return lookup(rows, best, [path], rows.columns, "left").select(*rows.columns, "best.root", "best.reachable")


def _root_by_level(rows: DataFrame, roots: DataFrame, levels: Sequence[int], path: str) -> DataFrame:
    found = rows.withColumn("path_ancestors", ancestors(path))
    for level in levels:
        own = roots.filter(F.col("level") == level).select(F.col("root").alias(f"root_{level}"), F.struct("root", "reachable").alias(f"held_{level}"))
        found = found.join(F.broadcast(own), F.try_element_at("path_ancestors", F.lit(level)) == F.col(f"root_{level}"), "left")
    nothing = F.lit(None).cast("struct<root: string, reachable: boolean>")
    best = F.coalesce(*[F.col(f"held_{level}") for level in reversed(levels)], nothing)
    return found.withColumn("best_root", best).select(*rows.columns, "best_root.root", "best_root.reachable")


def folder_key(folder: str, windows_paths: bool) -> Column:
    """How folders of a report and a catalog are compared: exactly, or by name key on Windows."""
    return name_key(folder) if windows_paths else F.col(folder)


def lookup_copy(copies: DataFrame, files: DataFrame, windows_paths: bool = False) -> DataFrame:
    """Each recorded copy with the current file it stands for: ``found_name``, size and time.

    The exact name wins; else a name equal by name key in the same folder, the smallest in ordinal
    order. One join on (folder key, name key) finds both, and its partitioning serves the choice.
    ``copies`` has ``set_id``, ``folder`` and ``file_name``.
    """
    keyed = files.withColumn("folder_key", folder_key("folder", windows_paths))
    recorded = copies.select("*", folder_key("folder", windows_paths).alias("folder_key"), name_key("file_name").alias("name_key"))
    folders = materialize(recorded.select("folder_key").distinct(), "recorded-folders", measure=["folder_key"])
    if small(folders):
        # Few folders are recorded: the rest of the catalog is not worth shuffling.
        keyed = keyed.join(F.broadcast(folders.df), "folder_key", "left_semi")
    current = keyed.select(
        "folder_key", name_key("name").alias("name_key"), F.col("name").alias("found_name"),
        F.col("size_bytes").alias("now_size"), F.col("mtime_us").alias("now_us"),
    )
    joined = recorded.join(current, ["folder_key", "name_key"], "left")
    preference = F.struct(F.col("found_name") != F.col("file_name"), sort_key("found_name"))
    found = F.struct("found_name", "now_size", "now_us")
    keys = ["folder_key", "name_key", *copies.columns]
    best = joined.groupBy(*keys).agg(F.min_by(found, preference).alias("found"))
    return best.select(*copies.columns, "found.found_name", "found.now_size", "found.now_us")


def folder_listing(folders: DataFrame, windows_paths: bool = False) -> DataFrame:
    """Whether each folder (by ``folder_key``) could be listed; marks for links or left-out files do not matter here."""
    failed = ~F.col("readable") & F.coalesce(F.col("reason") == "unlistable", F.lit(True))
    return folders.groupBy(folder_key("path", windows_paths).alias("folder_key")).agg(F.max(failed.cast("int")).alias("unlistable"))


def copy_state(tz: str) -> Column:
    """State of a recorded file copy, from the columns added by the lookups."""
    same = (F.col("now_size") == F.col("size_bytes")) & same_saved_date("now_us", "local_us", "utc_offset_s", tz)
    return (
        F.when(F.col("reachable") == F.lit(False), UNAVAILABLE)
        .when(F.col("unlistable") == 1, UNAVAILABLE)
        .when(F.col("found_name").isNull(), MISSING)
        .when(F.col("now_size").isNull() | F.col("now_us").isNull(), UNAVAILABLE)
        .when(same, PRESENT)
        .otherwise(CHANGED)
    )


def folder_state() -> Column:
    """State of a recorded folder copy, from its current rollup (``now_*``)."""
    same = (
        (F.col("now_file_count") == F.col("file_count"))
        & (F.col("now_folder_count") == F.col("folder_count"))
        & (F.col("now_size_bytes") == F.col("size_bytes"))
    )
    return (
        F.when(F.col("reachable") == F.lit(False), UNAVAILABLE)
        .when(F.col("now_readable").isNull(), MISSING)
        .when(~F.col("now_readable"), UNAVAILABLE)
        .when(same, PRESENT)
        .otherwise(CHANGED)
    )
