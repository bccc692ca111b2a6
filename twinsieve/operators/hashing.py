"""Hash cache, hash workload and the prefix stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Table, materialize
from ..sources.content import content_hashes
from .groups import join_groups, keep_repeated

# Files of at least this size are first compared by the hash of this many bytes.
FIRST_BYTES = 1 << 20
FIRST_BYTES_MIN = 16 << 20

GROUP = ["name_key", "saved_s", "size_bytes"]


def hash_workload(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates whose hash is not in the cache."""
    return candidates.join(cache.select("path"), "path", "left_anti")


def hash_files(candidates: Table, files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(path, md5) of every candidate: cached hashes, and new ones for the rest.

    ``candidates`` is written metadata, measured by path; contents come from ``files``.
    """
    if cache is None:
        return content_hashes(files, candidates)
    paths = candidates.df.select("path")
    known = cache.select("path", "md5").join(paths, "path", "left_semi")
    wanted = materialize(hash_workload(paths, cache), "to-hash", measure=["path"], columnar=True)
    return known if wanted.rows == 0 else known.unionByName(content_hashes(files, wanted))


def split_by_start(
    candidates: DataFrame,
    files: DataFrame,
    cache: DataFrame | None = None,
    first_bytes: int = FIRST_BYTES,
    first_bytes_min: int = FIRST_BYTES_MIN,
) -> DataFrame:
    """Split groups of large files by the hash of their first bytes, keeping groups of two or more.

    Smaller groups, and groups with a member whose full hash is cached, pass as they are. Returns
    the candidates with ``start_md5`` (null where a group passed).
    """
    return split_and_started(candidates, files, cache, first_bytes, first_bytes_min)[0]


def split_and_started(
    candidates: DataFrame,
    files: DataFrame,
    cache: DataFrame | None = None,
    first_bytes: int = FIRST_BYTES,
    first_bytes_min: int = FIRST_BYTES_MIN,
) -> tuple[DataFrame, DataFrame]:
    """``split_by_start``, and the (path) of all files whose first bytes were read for it."""
    as_is = F.lit(None).cast("string").alias("start_md5")
    is_large = F.col("size_bytes") >= first_bytes_min
    large, passed = candidates.filter(is_large), candidates.filter(~is_large).select("*", as_is)
    if cache is not None:
        cached = large.join(cache.select("path"), "path", "left_semi")
        hashed_groups = cached.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("cached_rows"))
        sizes = large.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_rows"))
        known = sizes.join(hashed_groups, GROUP, "left_semi")
        passed = passed.unionByName(join_groups(large, known, GROUP, ["path"]).select("*", as_is))
        unknown = sizes.join(hashed_groups, GROUP, "left_anti")
        large = join_groups(large, unknown, GROUP, ["path"])
    wanted = materialize(large, "large", measure=["path"], columnar=True)
    hashed = content_hashes(files, wanted, first_bytes).withColumnRenamed("md5", "start_md5")
    starts = materialize(hashed, "starts", columnar=True).df
    split = keep_repeated(wanted.df.join(starts, "path"), [*GROUP, "start_md5"], ["path"], wanted.rows)
    return passed.unionByName(split), starts.select("path")
