"""Duplicate files: equal name key, saved second and content."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators.filters import min_size, split_cold, split_unreadable
from ..operators.groups import keep_repeated
from ..operators.hashing import FIRST_BYTES, FIRST_BYTES_MIN, GROUP, hash_files, split_and_started
from ..operators.sets import Copies, date_size_groups, file_copies, file_sets
from ..session import Table, materialize
from ..sources.inventory import metadata


class FileDuplicates(NamedTuple):
    """``sets`` (one row each), ``copies`` (long form) and ``hashes`` (path, md5) of the candidates.

    ``separated`` (path) are candidates that needed no full hash: no other has their first bytes. None if none were compared.
    """

    sets: DataFrame
    copies: Copies
    hashes: DataFrame
    separated: DataFrame | None = None


def file_candidates(
    files: DataFrame, skip_cold: bool = False, ignore_empty: bool = False, minimum_size: int = 0
) -> DataFrame:
    """Metadata of the files that agree with another on everything but, perhaps, content."""
    known = split_unreadable(files).kept
    found = date_size_groups(metadata(min_size(known, minimum_size, ignore_empty)))
    if skip_cold:
        found = keep_repeated(split_cold(found).kept, GROUP, ["path"])
    return found


def hashed_candidates(
    files: DataFrame,
    candidates: DataFrame,
    hash_cache: DataFrame | None = None,
    first_bytes: int = FIRST_BYTES,
    first_bytes_min: int = FIRST_BYTES_MIN,
) -> Table:
    """Candidates with their full hash, as a written table; those that cannot be read drop out.

    The prefix stage saves reading whole objects. With a content column the scan has read the
    content anyway, so it is left out there; it never changes the result.
    """
    return hashed_and_separated(files, candidates, hash_cache, first_bytes, first_bytes_min)[0]


def hashed_and_separated(
    files: DataFrame,
    candidates: DataFrame,
    hash_cache: DataFrame | None = None,
    first_bytes: int = FIRST_BYTES,
    first_bytes_min: int = FIRST_BYTES_MIN,
) -> tuple[Table, DataFrame | None]:
    """``hashed_candidates``, and the (path) of those that the prefix stage read and left out."""
    started = None
    if "content" not in files.columns:
        candidates, started = split_and_started(candidates, files, hash_cache, first_bytes, first_bytes_min)
        candidates = candidates.drop("start_md5")
    listed: Table = materialize(candidates, "candidates", measure=["path"], columnar=True)
    hashes = hash_files(listed, files, hash_cache)
    separated = None if started is None else started.join(listed.df.select("path"), "path", "left_anti")
    return materialize(listed.df.join(hashes, "path"), "hashed", columnar=True), separated


def find_duplicate_files(
    files: DataFrame,
    skip_cold: bool = False,
    ignore_empty: bool = False,
    minimum_size: int = 0,
    hash_cache: DataFrame | None = None,
    first_bytes: int = FIRST_BYTES,
    first_bytes_min: int = FIRST_BYTES_MIN,
    tz: str | None = None,
) -> FileDuplicates:
    """Find sets of files with equal name key, saved second and MD5.

    ``hash_cache`` (path, md5) is trusted. Cheap columns decide first: content is hashed only for
    files that agree with another on name, second and size.
    """
    tz = tz or files.sparkSession.conf.get("spark.sql.session.timeZone")
    candidates = file_candidates(files, skip_cold, ignore_empty, minimum_size)
    hashed, separated = hashed_and_separated(files, candidates, hash_cache, first_bytes, first_bytes_min)
    rows = hashed.df
    return FileDuplicates(file_sets(rows, tz), file_copies(hashed), rows.select("path", "md5"), separated)
