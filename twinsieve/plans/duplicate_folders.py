"""Duplicate folders: equal name key and exactly equal trees."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_cold
from ..operators.groups import lookup
from ..operators.hashing import hash_files
from ..operators.hierarchy import (
    fingerprint, folder_base, folder_candidates, folder_copies, folder_members, folder_readable, folder_scope,
    folder_sets, top_most,
)
from ..operators.sets import Copies
from ..session import Table, materialize
from ..sources.inventory import metadata


class FolderDuplicates(NamedTuple):
    """Top-most ``sets`` and their ``copies``; ``all_members`` also has the nested sets."""

    sets: DataFrame
    copies: Copies
    all_members: DataFrame


def cheap_fingerprints(files: DataFrame, folders: DataFrame) -> Table:
    """Fingerprints by name, saved second and size; no content is read."""
    return fingerprint(folder_base(metadata(files), folders))


class FolderCandidates(NamedTuple):
    """What metadata says: all ``known`` folders, the candidates (``seeds``), the folders in their trees (``scope``) and
    the files there: ``listed``, and of those ``to_hash``."""

    known: DataFrame
    seeds: Table
    scope: Table
    listed: Table
    to_hash: Table


def folder_tree_candidates(files: DataFrame, folders: DataFrame, skip_cold: bool = False) -> FolderCandidates | None:
    """Trees equal in their metadata; None if there are none. No content is read, so this can run beside the file pass.

    Grouping by (name key, fingerprint) implies a repeated name, so names need no pass of their own.
    """
    known = materialize(folder_readable(folders), "folders").df
    cheap = cheap_fingerprints(files, known)
    candidates = folder_candidates(cheap.df, cheap.rows).select("path")
    seeds = materialize(candidates, "folder-candidates", measure=["path"])
    if seeds.rows == 0:
        return None
    scope = materialize(folder_scope(known, seeds), "folder-scope", measure=["path"])
    holding = scope._replace(df=scope.df.select(F.col("path").alias("folder")))
    inside = lookup(metadata(files), holding, ["folder"], ["path"])
    listed = materialize(inside, "scope-files", measure=["path"], columnar=True)
    to_hash = listed
    if skip_cold:
        local = listed.df.filter(~is_cold("attributes"))
        to_hash = materialize(local, "scope-local-files", measure=["path"], columnar=True)
    return FolderCandidates(known, seeds, scope, listed, to_hash)


def confirmed_members(files: DataFrame, found: FolderCandidates | None, hash_cache: DataFrame | None = None) -> Table:
    """Members of all folder sets, confirmed by content.

    The files below the candidates that are not in ``hash_cache`` are hashed, and those trees are fingerprinted again.
    """
    if found is None:
        return Table(_no_members(files.sparkSession), 0, 0)
    hashes = hash_files(found.to_hash, files, hash_cache)
    hashed = found.listed.df.join(hashes, "path", "left")
    full = fingerprint(folder_base(hashed, lookup(found.known, found.scope, ["path"], ["path"]), with_md5=True))
    confirmed = lookup(full.df, found.seeds, ["path"], ["path"], total=full.rows)
    return materialize(folder_members(confirmed, full.rows), "folder-members")


def _no_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "path string, level int, fingerprint string, file_count bigint, folder_count bigint, size_bytes bigint, "
        "name_key string, set_id string",
    )


def find_duplicate_folders(
    files: DataFrame, folders: DataFrame, skip_cold: bool = False, hash_cache: DataFrame | None = None
) -> FolderDuplicates:
    """Find sets of folders with the same name and the same tree; only the top-most are listed."""
    return top_duplicates(confirmed_members(files, folder_tree_candidates(files, folders, skip_cold), hash_cache))


def top_duplicates(members: Table) -> FolderDuplicates:
    """The top-most sets of written members."""
    top = top_most(members.df, members.rows)
    return FolderDuplicates(folder_sets(top), folder_copies(top, members.rows), members.df)
