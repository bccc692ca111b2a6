"""Leaving files and folders out of a catalog."""

from __future__ import annotations

from typing import Iterable, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import check_pattern, matches_any, name_key
from ..functions.paths import components, level_of_root
from ..functions.values import is_cold
from ..sources.inventory import EXCLUDED_FILE, LINK, Catalog


def deepest_match(path: str, patterns: Sequence[str]) -> Column:
    """Position of the deepest component of a path whose name matches a pattern; 0 if none does.

    A folder at that position or below sees the path; every folder above does not.
    """
    if not patterns:
        return F.lit(0)
    hit = lambda part, i: F.when(matches_any(name_key(part), patterns), i + 1).otherwise(0)
    return F.coalesce(F.array_max(F.transform(components(path), hit)), F.lit(0))


def _root_level(path: str, roots: Sequence[str] | None) -> Column:
    """Position of the scan root in a path: the longest given root holding it, else the first name."""
    p = F.col(path)
    if roots is None:
        return F.lit(1)
    level = F.lit(0)
    for root in sorted(roots, key=len):
        bare = root.rstrip("/\\")
        inside = (p == root) | p.startswith(bare + "/") | p.startswith(bare + "\\")
        level = F.when(inside, F.lit(level_of_root(root))).otherwise(level)
    return level


def exclude_names(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Leave out files whose own name matches a pattern."""
    patterns = _checked(patterns)
    return files if not patterns else files.filter(~matches_any(name_key("name"), patterns))


def exclude_folders(catalog: Catalog, patterns: Iterable[str], roots: Sequence[str] | None = None) -> Catalog:
    """Leave out matching folders with everything below them; a scan root is never left out.

    Runs before any unreadable mark is used, so an excluded link marks nothing.
    """
    patterns = _checked(patterns)
    if not patterns:
        return catalog
    outside = lambda path: deepest_match(path, patterns) <= _root_level(path, roots)
    return Catalog(catalog.files.filter(outside("folder")), catalog.folders.filter(outside("path")))


def exclude(catalog: Catalog, patterns: Iterable[str], roots: Sequence[str] | None = None) -> Catalog:
    """Both rules: matching files, and matching folders with their trees."""
    patterns = _checked(patterns)
    pruned = exclude_folders(catalog, patterns, roots)
    return Catalog(exclude_names(pruned.files, patterns), pruned.folders)


def _checked(patterns: Iterable[str]) -> list[str]:
    patterns = list(patterns)
    for pattern in patterns:
        check_pattern(pattern)
    return patterns


def min_size(files: DataFrame, minimum_size: int = 0, ignore_empty: bool = False) -> DataFrame:
    """Files of at least a size. Used for file matching only, never for folders."""
    if minimum_size < 0:
        raise ValueError(f"minimum_size is negative: {minimum_size}.")
    smallest = max(minimum_size, 1) if ignore_empty else minimum_size
    return files.filter(F.col("size_bytes") >= smallest) if smallest else files


def exclude_paths(catalog: Catalog, paths: DataFrame) -> Catalog:
    """Leave out exact paths (such as the report's own files); their folders become unreadable.

    ``paths`` has one column ``path``.
    """
    wanted = paths.select("path").distinct()
    found = catalog.files.select("path", "folder").join(wanted, "path", "left_semi")
    marked = found.select(F.col("folder").alias("path")).distinct().select(
        "path", F.lit(False).alias("readable"), F.lit(EXCLUDED_FILE).alias("reason")
    )
    return Catalog(catalog.files.join(wanted, "path", "left_anti"), catalog.folders.unionByName(marked))


def mark_links(folders: DataFrame) -> DataFrame:
    """Folder links (``is_link``) are not followed: they stay listed, as unreadable."""
    link = F.coalesce(F.col("is_link"), F.lit(False))
    return folders.select(
        "path",
        (F.col("readable") & ~link).alias("readable"),
        F.when(link, F.lit(LINK)).otherwise(F.col("reason")).alias("reason"),
    )


class Split(NamedTuple):
    kept: DataFrame
    skipped: DataFrame


def split_cold(files: DataFrame) -> Split:
    """Files stored locally, and those whose content would have to be fetched."""
    cold = is_cold("attributes")
    return Split(files.filter(~cold), files.filter(cold))


def split_unreadable(files: DataFrame) -> Split:
    """Files with known size and time, and those without."""
    known = F.col("size_bytes").isNotNull() & F.col("mtime_us").isNotNull()
    return Split(files.filter(known), files.filter(~known))
