"""Scan a catalog and publish its report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import exclude, exclude_paths, min_size
from ..operators.sets import scan_totals
from ..operators.warnings import scan_warnings
from ..session import materialize, together
from ..sources.inventory import Catalog, metadata
from ..sources.report import (
    ScanSettings, file_tables, folder_tables, read_report, report_exists, write_report,
)
from .duplicate_files import FileDuplicates, file_candidates, find_duplicate_files
from .duplicate_folders import FolderCandidates, FolderDuplicates, confirmed_members, folder_tree_candidates, top_duplicates
from .rescan import previous_hashes


@dataclass(frozen=True)
class ScanResult:
    """What a scan has found. ``skipped`` is worked out when it is first asked for."""

    files: FileDuplicates
    folders: FolderDuplicates | None
    totals: DataFrame
    warnings: list[str]
    version: int | None
    find_skipped: Callable[[], DataFrame]

    @cached_property
    def skipped(self) -> DataFrame:
        return self.find_skipped()


def scan(
    spark: SparkSession,
    catalog: Catalog,
    report_dir: str | None = None,
    settings: ScanSettings | None = None,
    include_folders: bool = True,
    rehash: bool = False,
    dry_run: bool = False,
    skip_cold: bool = False,
    ignore_empty: bool = False,
    roots: Sequence[str] | None = None,
    own_files: DataFrame | None = None,
    tz: str | None = None,
    windows_paths: bool = False,
) -> ScanResult:
    """Find duplicate files and folders and publish them at ``report_dir``.

    Hashes in an earlier report there are reused unless ``rehash``; a report that cannot be read
    only warns. ``own_files`` (column ``path``) are left out, such as the report's own tables. ``skipped`` of the
    result has (kind, path, reason) rows for what could not be listed, sized or read. If no content at all could be
    read, the scan fails and publishes nothing.
    """
    settings = settings or ScanSettings()
    catalog = exclude(catalog, settings.exclude_names, roots)
    if own_files is not None:
        catalog = exclude_paths(catalog, own_files)
    warnings: list[str] = []
    cache = None
    if report_dir is not None and not rehash and report_exists(spark, report_dir):
        try:
            earlier = read_report(spark, report_dir)
            reused = previous_hashes(earlier.file_copies, catalog.files, tz, windows_paths)
            cache = materialize(reused, "reused-hashes", columnar=True).df
        except (AnalysisException, OSError, ValueError) as problem:
            warnings.append(f"Hashes of '{report_dir}' are not reused: {problem}")

    def find_files() -> FileDuplicates:
        return find_duplicate_files(catalog.files, skip_cold, ignore_empty, settings.minimum_size, hash_cache=cache, tz=tz)

    def compare_trees() -> FolderCandidates | None:
        return folder_tree_candidates(catalog.files, catalog.folders, skip_cold) if include_folders else None

    files, trees = together(find_files, compare_trees)
    folders = None
    if include_folders:
        # The file pass has hashed almost everything below a duplicate folder already.
        known = files.hashes if cache is None else files.hashes.unionByName(cache).dropDuplicates(["path"])
        folders = top_duplicates(confirmed_members(catalog.files, trees, known))
    # Files told apart by their first bytes were read as far as they need.
    nothing_read = files.copies.rows == 0 and (files.separated is None or files.separated.isEmpty())
    if nothing_read and not file_candidates(catalog.files, skip_cold, ignore_empty, settings.minimum_size).isEmpty():
        raise OSError("No content could be read of any file that needs it; nothing is published.")

    def find_skipped() -> DataFrame:
        considered = catalog.files.filter("size_bytes is null").unionByName(
            min_size(catalog.files.filter("size_bytes is not null"), settings.minimum_size, ignore_empty)
        )
        checked = (files.hashes if cache is None else files.hashes.unionByName(cache)).select("path")
        if files.separated is not None:
            checked = checked.unionByName(files.separated)
        return scan_warnings(metadata(considered), catalog.folders, checked, skip_cold)

    totals = scan_totals(files.sets, folders.sets if folders else None)
    version = None
    if report_dir is not None and not dry_run:
        file_rows, file_copies = file_tables(files.sets, files.copies)
        folder_rows = folder_copies = None
        if folders:
            folder_rows, folder_copies = folder_tables(folders.sets, folders.copies)
        smallest = max(settings.minimum_size, 1) if ignore_empty else settings.minimum_size
        version = write_report(
            spark, report_dir, file_rows, file_copies, folder_rows, folder_copies,
            ScanSettings(list(settings.exclude_names), smallest),
        )
    return ScanResult(files, folders, totals, warnings, version, find_skipped)
