"""Catalog source: a file tree every executor can reach, by mount or by URI, listed level by level."""

from __future__ import annotations

import os
import stat
from functools import reduce
from typing import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import matches_any, name_key
from ..operators.filters import exclude_paths
from ..session import materialize, partitions_for
from .content import is_uri, local_path, located
from .inventory import LINK, UNLISTABLE, Catalog

NOT_TEXT = "name is not UTF-8"

_ENTRY = (
    "kind string, path string, folder string, name string, size_bytes bigint, mtime_us bigint, "
    "attributes int, reason string"
)
_BATCH = 50_000
FOLDERS_PER_TASK = 1_000
FILES_PER_TASK = 20_000


def _entries(folder: str) -> Iterator[tuple]:
    """Files, sub folders and folder links of one folder; one error row if it cannot be listed.

    Mounts and ``file`` URIs are listed alike, name by name and without following folder links; sizes and times, for which
    ``attributes`` is null as yet, are read afterwards. Devices, pipes and sockets are neither files nor folders. Links to files
    count as files.
    """
    mounted = local_path(folder)
    if mounted is None:
        yield from _objects(folder)
        return
    try:
        with os.scandir(mounted) as listing:
            for entry in listing:
                path = entry.path if mounted == folder else f"{folder.rstrip('/')}/{entry.name}"
                if not _is_text(entry.name):
                    yield "skipped", _shown(path), folder, _shown(entry.name), None, None, 0, NOT_TEXT
                    continue
                try:
                    kind = _kind(entry)
                except OSError as problem:
                    yield "skipped", path, folder, entry.name, None, None, 0, problem.strerror
                    continue
                if kind is not None:
                    yield kind, path, folder, entry.name, None, None, None if kind == "file" else 0, LINK if kind == "link" else None
    except OSError as problem:
        yield "error", folder, folder, "", None, None, 0, problem.strerror


def _kind(entry: os.DirEntry) -> str | None:
    """``folder``, ``link`` (to a folder), ``file``, or None: nothing that is scanned."""
    if entry.is_symlink():
        try:
            mode = entry.stat().st_mode
        except FileNotFoundError:
            return None
        return "link" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else None
    if entry.is_dir(follow_symlinks=False):
        return "link" if hasattr(entry, "is_junction") and entry.is_junction() else "folder"
    return "file" if entry.is_file(follow_symlinks=False) else None


def _objects(folder: str) -> Iterator[tuple]:
    """The same for a folder of an object store or another file system, which tells sizes and times at once."""
    try:
        system, inner = located(folder)
        found = system.get_file_info(fs.FileSelector(inner))
    except OSError as problem:
        yield "error", folder, folder, "", None, None, 0, str(problem)
        return
    for info in found:
        path = f"{folder.rstrip('/')}/{info.base_name}"
        if info.type == fs.FileType.Directory:
            yield "folder", path, folder, info.base_name, None, None, 0, None
        elif info.type == fs.FileType.File:
            saved = None if info.mtime_ns is None else info.mtime_ns // 1000
            yield "file", path, folder, info.base_name, info.size, saved, 0, None


def _sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Listed files with their sizes, times and attributes; nulls where a file is gone or cannot be looked at."""

    def look(path: str) -> tuple[int | None, int | None, int]:
        try:
            info = os.stat(local_path(path))
        except OSError:
            return None, None, 0
        return info.st_size, info.st_mtime_ns // 1000, getattr(info, "st_file_attributes", 0)

    for batch in batches:
        found = pd.DataFrame([look(p) for p in batch["path"]], columns=["size_bytes", "mtime_us", "attributes"], index=batch.index)
        yield batch.assign(**found.astype({"size_bytes": "Int64", "mtime_us": "Int64", "attributes": "Int32"}))


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _shown(name: str) -> str:
    """A name whose bytes are not UTF-8, with those bytes escaped."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ENTRY.split(", ")]
    rows: list[tuple] = []

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=columns)
        return made.astype({"size_bytes": "Int64", "mtime_us": "Int64", "attributes": "Int32"})

    for batch in batches:
        for folder in batch["path"]:
            for row in _entries(folder):
                rows.append(row)
                if len(rows) == _BATCH:
                    yield frame()
                    rows.clear()
    if rows:
        yield frame()


def scan_tree(
    spark: SparkSession, root: str, exclude_names: Iterable[str] = (), own_files: DataFrame | None = None
) -> tuple[Catalog, DataFrame]:
    """List a tree: its catalog, and a warning per folder or entry that had to be skipped.

    Each level's folders are spread over the executors; folders left out by name are never listed,
    folder links are not followed, and a folder that cannot be read does not stop the scan. Files are looked at when all names are
    known, in ranges of paths, so the files of one large folder go to several tasks. An entry whose name is
    not UTF-8 is skipped with a warning, and its folder is never taken for fully known.
    """
    mounted = local_path(root)
    if mounted is None:
        system, inner = located(root)
        is_folder = system.get_file_info(inner).type == fs.FileType.Directory
    else:
        is_folder, root = os.path.isdir(mounted), root if is_uri(root) else os.path.abspath(root)
    if not is_folder:
        raise NotADirectoryError(f"'{root}' is not a folder.")
    patterns = list(exclude_names)
    frontier = spark.createDataFrame([(root,)], "path string")
    listed, roots, folders_found, rows = [], frontier.withColumn("readable", F.lit(True)), 1, 0
    while True:
        found = frontier.repartition(partitions_for(spark, folders_found, FOLDERS_PER_TASK)).mapInPandas(_list, _ENTRY)
        left_out = F.col("kind").isin("file", "folder", "link") & matches_any(name_key("name"), patterns)
        level = materialize(found.filter(~left_out) if patterns else found, "listing", columnar=True)
        listed.append(level.df)
        rows += level.rows
        frontier = level.df.filter("kind = 'folder'").select("path")
        folders_found = frontier.count()
        if folders_found == 0:
            break
    entries = reduce(DataFrame.unionByName, listed)
    names = entries.filter("kind = 'file'").select("path", "folder", "name", "size_bytes", "mtime_us", "attributes")
    files = names.filter("attributes is not null")
    if mounted is not None:
        tasks = partitions_for(spark, rows, FILES_PER_TASK)
        unsized = names.repartitionByRange(tasks, "path") if tasks > 1 else names
        files = materialize(unsized.mapInPandas(_sized, names.schema), "sizes", columnar=True).df
    failed = F.col("kind") == "error"
    folders = entries.filter(F.col("kind").isin("folder", "link", "error")).select(
        "path", (F.col("kind") == "folder").alias("readable"),
        F.when(failed, F.lit(UNLISTABLE)).otherwise(F.col("reason")).alias("reason"),
    ).unionByName(roots.withColumn("reason", F.lit(None).cast("string")))
    # What such a folder holds is not fully known.
    unknown = entries.filter(F.col("reason") == NOT_TEXT).select(F.col("folder").alias("path"), F.lit(False).alias("readable"), "reason")
    folders = folders.unionByName(unknown.distinct())
    catalog = Catalog(files, folders)
    if own_files is not None:
        catalog = exclude_paths(catalog, own_files)
    warnings = entries.filter(F.col("kind").isin("error", "skipped")).select(
        F.when(failed, F.lit("folder")).otherwise(F.lit("entry")).alias("kind"), "path", "reason"
    )
    return catalog, warnings
