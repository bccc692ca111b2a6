"""Folder trees as relations: parents, closures, rollups and fingerprints."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import location_order, matches_any, name_key, path_order, sort_key
from ..functions.paths import ancestors, base_name, parent_of, tree_level
from ..session import Table, materialize, small
from .filters import deepest_match, split_unreadable
from .groups import group_id, join_groups, keep_repeated, lookup
from .sets import Copies, copies_of

# A digest is eight numbers of seven hex digits: sums of 2**35 of them fit a BIGINT.
_LIMBS = 8
_DIGITS = 7
LIMBS = [f"limb{i}" for i in range(_LIMBS)]

# Levels computed by one job before the result is written and the lineage cut.
LEVELS_PER_JOB = 4


def folder_readable(folders: DataFrame) -> DataFrame:
    """One row per folder; any unreadable mark wins."""
    return folders.groupBy("path").agg(F.bool_and("readable").alias("readable"))


def folder_children(folders: DataFrame) -> DataFrame:
    """(path, parent) of every folder whose parent is catalogued too."""
    known = folders.select("path").distinct()
    linked = known.withColumn("parent", parent_of("path")).filter("parent <> path")
    return lookup(linked, known.withColumnRenamed("path", "parent"), ["parent"], ["path"])


def files_in_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files whose folder is catalogued."""
    known = folders.select(F.col("path").alias("folder")).distinct()
    return lookup(files, known, ["folder"], ["path"])


def folder_scope(folders: DataFrame, seeds: DataFrame | Table, total: int | None = None) -> DataFrame:
    """The ``seeds`` (column ``path``, distinct) and every catalogued folder below them.

    Equi-join on each folder's ancestors, so no recursion. A folder near the root is the ancestor of
    most rows; such keys are spread.
    """
    lines = folders.select("path").distinct().withColumn("above", F.explode(ancestors("path")))
    table = seeds if isinstance(seeds, Table) else materialize(seeds, "seeds", measure=["path"])
    wanted = table._replace(df=table.df.select(F.col("path").alias("above")))
    return lookup(lines, wanted, ["above"], ["path"]).select("path").distinct()


def repeated_names(folders: DataFrame) -> DataFrame:
    """Folders whose name key another folder has."""
    known = folders.select("path").distinct().withColumn("name_key", name_key(base_name("path")))
    return keep_repeated(known, ["name_key"], ["path"])


def repeated_name_scope(folders: DataFrame) -> DataFrame:
    """Folders that could be duplicates by name, and everything below them."""
    return folder_scope(folders, repeated_names(folders).select("path"))


def tainted_folders(folders: DataFrame, files: DataFrame, unhashed: DataFrame | None = None) -> DataFrame:
    """Folders whose content is not fully known: marked unreadable, or holding an unreadable file.

    ``unhashed`` are further files (``folder``) that should have a hash and have none.
    """
    marked = folders.filter(~F.col("readable")).select("path")
    gone = split_unreadable(files).skipped.select(F.col("folder").alias("path"))
    sources = [marked, gone] + ([] if unhashed is None else [unhashed.select(F.col("folder").alias("path"))])
    return reduce(DataFrame.unionByName, sources).distinct()


def provable_folders(folders: DataFrame, tainted: DataFrame) -> DataFrame:
    """Folders with nothing tainted in or below them. A bad folder spoils those above, not beside it."""
    spoiled = tainted.select(F.explode(ancestors("path")).alias("path")).distinct()
    return folders.select("path").distinct().join(spoiled, "path", "left_anti")


def folder_rollup(
    files: DataFrame, folders: DataFrame, patterns: Sequence[str] = (), recorded: Table | None = None, windows_paths: bool = False
) -> DataFrame:
    """Per folder: files, sub folders and bytes of its whole tree, and whether all could be read.

    With ``patterns`` matching names are left out as seen from each folder: a folder whose own name,
    or one above it, matches still has its tree counted. Rows are summed per folder before each
    folder is exploded to its ancestors; the final sums combine before the shuffle. Only the ``recorded`` folders
    (``folder_key``) are needed by a caller that gives them: a list of measured size is broadcast, and the rest is
    not summed up.
    """
    patterns = list(patterns)
    known = folders.groupBy("path").agg(F.min(F.col("readable").cast("int")).alias("readable"))
    visible = files if not patterns else files.filter(~matches_any(name_key("name"), patterns))
    direct = visible.groupBy(F.col("folder").alias("path")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("bytes"),
        F.count_if(F.col("size_bytes").isNull()).alias("unsized"),
    )
    rows = known.join(direct, "path", "left").select(
        "path", deepest_match("path", patterns).alias("seen_from"), "readable",
        F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
        (F.coalesce("unsized", F.lit(0)) == 0).cast("int").alias("sized"),
    )
    above = rows.select("*", F.explode(ancestors("path")).alias("above"))
    if patterns:
        above = above.filter(tree_level("above") >= F.col("seen_from"))
    if recorded is not None and small(recorded):
        keyed = above.withColumn("folder_key", name_key("above") if windows_paths else F.col("above"))
        above = keyed.join(F.broadcast(recorded.df), "folder_key", "left_semi").drop("folder_key")
    is_self = F.col("above") == F.col("path")
    summed = above.groupBy("above").agg(
        F.sum("files").cast("bigint").alias("file_count"),
        F.count_if(~is_self).alias("folder_count"),
        F.sum("bytes").cast("bigint").alias("size_bytes"),
        F.min(F.least("readable", "sized")).alias("readable"),
        F.max(is_self.cast("int")).alias("catalogued"),
    )
    return summed.filter("catalogued = 1").select(
        F.col("above").alias("path"), "file_count", "folder_count", "size_bytes",
        (F.col("readable") == 1).alias("readable"),
    )


# ---------------------------------------------------------------- fingerprints


def limbs_of(digest: str) -> list[Column]:
    """The eight numbers of a SHA-256 column."""
    piece = "cast(conv(substring({}, {}, {}), 16, 10) as bigint) as {}"
    return [F.expr(piece.format(digest, 1 + i * _DIGITS, _DIGITS, limb)) for i, limb in enumerate(LIMBS)]


def _summed_limbs() -> list[Column]:
    return [F.sum(limb).alias(limb) for limb in LIMBS]


def file_line(with_md5: bool) -> tuple[Column, Column]:
    """A file's line in its folder, and whether everything in it is known."""
    complete = F.col("size_bytes").isNotNull() & F.col("mtime_us").isNotNull()
    parts = [F.lit("F"), F.col("saved_s").cast("string"), F.col("size_bytes").cast("string")]
    if with_md5:
        complete = complete & F.col("md5").isNotNull()
        parts.append(F.col("md5"))
    return F.sha2(F.concat_ws("|", *parts, F.col("name_key")), 256), complete


def folder_line(fingerprint: str, path: str) -> Column:
    """A folder's line in the folder above it."""
    return F.sha2(F.concat_ws("|", F.lit("D"), F.col(fingerprint), name_key(base_name(path))), 256)


def digest_of_sums() -> Column:
    """A folder's fingerprint, from its number of lines and their sums."""
    return F.sha2(F.concat_ws("|", "lines", *LIMBS), 256)


def folder_base(files: DataFrame, folders: DataFrame, with_md5: bool = False) -> Table:
    """Each folder's own content as fixed-width sums, written by tree level.

    ``files`` is metadata (with ``md5`` for the content pass). The digest of a set of lines is the sum
    of the lines' hashes: like sorting and hashing the lines it does not depend on their order, but
    it can be combined before the shuffle, so a folder of any width is never gathered in one place.
    A file without size, time or (in the content pass) hash leaves its folder unprovable.
    """
    line, complete = file_line(with_md5)
    lines = files.select(F.col("folder").alias("path"), "size_bytes", complete.cast("int").alias("complete"), line.alias("line"))
    direct = lines.select("*", *limbs_of("line")).groupBy("path").agg(
        *_summed_limbs(),
        F.count(F.lit(1)).alias("lines"),
        F.sum("size_bytes").alias("bytes"),
        F.min("complete").alias("complete"),
    )
    known = folders.groupBy("path").agg(F.min(F.col("readable").cast("int")).alias("readable"))
    rows = known.join(direct, "path", "left")
    number = lambda c, default=0: F.coalesce(F.col(c), F.lit(default)).cast("bigint").alias(c)
    base = rows.select(
        "path", tree_level("path").alias("level"),
        *[number(limb) for limb in LIMBS], number("lines"), number("bytes"),
        F.least("readable", F.coalesce("complete", F.lit(1))).alias("provable"),
    )
    # Sorted by level, a reader of one level skips most of each file.
    return materialize(base.sortWithinPartitions("level"), "folder-base", extremes="level", columnar=True)


def fingerprint(base: Table, levels_per_job: int = LEVELS_PER_JOB) -> Table:
    """Fingerprint every folder tree, deepest level first.

    A folder adds one line per sub folder (name key and fingerprint) to its own sums. One
    shuffle per level, of folders only; every ``levels_per_job`` levels the result is written. Columns:
    path, level, fingerprint (null when not provable), file_count, folder_count, size_bytes.
    """
    if base.most is None:
        return Table(_level(base.df, None).withColumn("level", F.lit(0)), 0, 0)
    written: list[DataFrame] = []
    below: DataFrame | None = None
    rows = 0
    top = base.least
    for deepest in range(base.most, top - 1, -levels_per_job):
        batch = []
        for level in range(deepest, max(deepest - levels_per_job, top - 1), -1):
            below = _level(base.df.filter(F.col("level") == level), below).withColumn("level", F.lit(level))
            batch.append(below)
        table = materialize(reduce(DataFrame.unionByName, batch), "fingerprints")
        written.append(table.df)
        rows += table.rows
        below = table.df.filter(F.col("level") == max(deepest - levels_per_job + 1, top))
    return Table(reduce(DataFrame.unionByName, written), rows, 0)


def _level(own: DataFrame, below: DataFrame | None) -> DataFrame:
    """Fingerprints of one level from its folders' own sums and the finished level below."""
    lines = own.selectExpr(
        "path", *LIMBS, "lines", "lines as files", "0L as folders", "bytes", "provable", "1 as own"
    )
    if below is not None:
        children = below.select(
            parent_of("path").alias("path"), folder_line("fingerprint", "path").alias("line"), "fingerprint", "file_count", "folder_count",
            "size_bytes",
        ).select(
            "path", *limbs_of("line"), F.expr("1L as lines"), F.col("file_count").alias("files"),
            F.expr("folder_count + 1 as folders"), F.col("size_bytes").alias("bytes"),
            F.expr("cast(fingerprint is not null as int) as provable"), F.lit(0).alias("own"),
        )
        lines = lines.unionByName(children).groupBy("path").agg(
            *_summed_limbs(),
            *[F.sum(c).alias(c) for c in ("lines", "files", "folders", "bytes")],
            F.min("provable").alias("provable"), F.max("own").alias("own"),
        ).filter("own = 1")
    return lines.select(
        "path", F.when(F.col("provable") == 1, digest_of_sums()).alias("fingerprint"),
        F.col("files").alias("file_count"), F.col("folders").alias("folder_count"), F.col("bytes").alias("size_bytes"),
    )


# ---------------------------------------------------------------- sets of folders


def folder_candidates(fingerprints: DataFrame, total: int | None = None) -> DataFrame:
    """Provable folders holding a file somewhere whose name key and fingerprint another folder has."""
    usable = fingerprints.filter(F.col("fingerprint").isNotNull() & (F.col("file_count") > 0))
    named = usable.withColumn("name_key", name_key(base_name("path")))
    return keep_repeated(named, ["name_key", "fingerprint"], ["path"], total)


def folder_members(fingerprints: DataFrame, total: int | None = None) -> DataFrame:
    """Members of every folder set, with the set's id; nested sets included."""
    members = folder_candidates(fingerprints, total)
    return members.withColumn("set_id", group_id("fingerprint", "name_key"))


def top_most(members: DataFrame, total: int | None = None) -> DataFrame:
    """Drop a set iff every member sits in a folder that is itself a member of some set."""
    with_parent = members.withColumn("parent", parent_of("path"))
    inside = members.select(F.col("path").alias("parent"), F.lit(1).alias("nested"))
    marked = lookup(with_parent, inside, ["parent"], ["path"], "left", total)
    groups = marked.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("group_rows"), F.count_if(F.col("nested").isNull()).alias("outside")
    )
    kept = groups.filter("outside > 0").drop("outside")
    return join_groups(members, kept, ["set_id"], ["path"], total=total)


def folder_sets(members: DataFrame) -> DataFrame:
    """One row per folder set; the first location in order names it."""
    first = F.struct("path", "file_count", "folder_count", "size_bytes")
    grouped = members.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(first, F.struct(*location_order("path"))).alias("first")
    )
    return grouped.select(
        "set_id", base_name("first.path").alias("folder_name"),
        "first.file_count", "first.folder_count", "first.size_bytes", "copies",
        F.col("first.path").alias("first_location"),
    )


def folder_order() -> list[Column]:
    """Row order of folder sets: name ignoring case, size, first location in path order."""
    return [sort_key("folder_name", ignore_case=True), F.col("size_bytes"), *path_order("first_location")]


def folder_copies(members: DataFrame, total: int) -> Copies:
    """One row per copy of a folder set, with the size of its set."""
    return copies_of(members.select("set_id", F.col("path").alias("folder"), "path"), total)
