"""From hashed rows to duplicate sets and their copies, and views of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import location_order, scan_key, sort_key
from ..functions.times import saved_second, utc_offset
from ..session import Table
from .groups import few, group_counts, group_id, join_groups, keep_repeated, measured_groups


def name_groups(files: DataFrame) -> DataFrame:
    """Files whose name key another file has."""
    return keep_repeated(files, ["name_key"], ["path"])


def date_size_groups(files: DataFrame) -> DataFrame:
    """Files sharing name key, saved second and size with another.

    Implies :func:`name_groups`, which therefore needs no pass of its own.
    """
    return keep_repeated(files, ["name_key", "saved_s", "size_bytes"], ["path"])


def with_set_id(hashed: DataFrame) -> DataFrame:
    return hashed.withColumn("set_id", group_id("md5", "size_bytes", "saved_s", "name_key"))


def file_sets(hashed: DataFrame, tz: str) -> DataFrame:
    """One row per duplicated file. The first copy in scan order names it and gives its time."""
    first = F.struct("name", "mtime_us", "size_bytes", "md5")
    grouped = with_set_id(hashed).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(first, scan_key("folder", "name")).alias("first")
    )
    return grouped.filter("copies > 1").select(
        "set_id",
        F.col("first.name").alias("file_name"),
        F.col("first.mtime_us").alias("saved_us"),
        utc_offset(saved_second("first.mtime_us"), tz).alias("utc_offset_s"),
        F.col("first.size_bytes").alias("size_bytes"),
        F.col("first.md5").alias("md5"),
        "copies",
    )


class Copies(NamedTuple):
    """Copies of sets in long form; upper bounds of the widest set's size and of all rows."""

    df: DataFrame
    widest: int
    rows: int


def copies_of(rows: DataFrame, total: int) -> Copies:
    """``rows`` (with ``set_id`` and ``path``; ``total`` of them) of sets with two rows or more.

    The size of its set is added to each row in ``copies``.
    """
    groups: DataFrame | Table = group_counts(rows, ["set_id"]).filter("group_rows > 1")
    widest = total
    if not few(total):
        groups = measured_groups(groups)
        widest = groups.most or 0
    joined = join_groups(rows, groups, ["set_id"], ["path"], "inner", total)
    return Copies(joined.withColumnRenamed("group_rows", "copies"), widest, total)


def file_copies(hashed: Table) -> Copies:
    """One row per copy of a duplicated file; the whole result, in long form."""
    return copies_of(with_set_id(hashed.df).select("set_id", "folder", "name", "path"), hashed.rows)


def with_locations(sets: DataFrame, copies: DataFrame, most: int, location: str = "folder") -> DataFrame:
    """The array view: each set's locations in order, repeats kept.

    Meant for reading small results. The caller says how many locations one row may hold; a larger set is an
    error, raised before anything is collected. The long form is the result and has no such limit.
    """
    too_wide = F.concat(F.lit("A set has "), F.col("copies"), F.lit(f" copies; a row was to hold at most {most}."))
    fits = F.when(F.col("copies") > most, F.raise_error(too_wide).cast("boolean")).otherwise(True)
    depth, folded, exact = location_order(location)
    entry = F.struct(depth.alias("d"), folded.alias("u"), exact.alias("x"), F.col(location).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["at"])
    lists = copies.filter(fits).groupBy("set_id").agg(ordered.alias("locations"))
    return sets.join(lists, "set_id")


def wide_locations(ranked: DataFrame, fixed: DataFrame, max_n: int | None = None, location: str = "folder") -> DataFrame:
    """One column per copy, ``location_1`` to ``location_n``, beside the ``fixed`` columns of each set.

    ``ranked`` are copies with their ``pos``. The view is as wide as its widest set; with ``max_n`` it has that
    many columns, and a wider set is an error, never cut.
    """
    widest = ranked.agg(F.max("pos")).first()[0] or 0
    if max_n is not None and widest > max_n:
        raise ValueError(f"A set has {widest} copies; the view was to hold at most {max_n}.")
    columns = range(1, (widest if max_n is None else max_n) + 1)
    numbered = ranked.select("set_id", F.col("pos").cast("int").alias("pos"), location)
    pivoted = numbered.groupBy("set_id").pivot("pos", list(columns) or [0]).agg(F.first(location))
    named = pivoted.select("set_id", *[F.col(f"`{n}`").alias(f"location_{n}") for n in columns])
    return fixed.join(named, "set_id")


def from_wide(wide: DataFrame, ids: list[str]) -> DataFrame:
    """Long copies of a wide view; blanks are skipped and positions closed up."""
    columns = sorted((c for c in wide.columns if c.startswith("location_")), key=lambda c: int(c.split("_")[1]))
    given = F.filter(F.array(*columns), lambda at: F.coalesce(at, F.lit("")) != "")
    listed = wide.select(*ids, given.alias("given"))
    return listed.select(*ids, F.size("given").cast("bigint").alias("copies"), F.posexplode("given").alias("at", "folder")).select(
        *ids, "copies", (F.col("at") + 1).cast("bigint").alias("pos"), "folder"
    )


def set_order() -> list:
    """Row order of file sets: name ignoring case, saved time, hash."""
    return [sort_key("file_name", ignore_case=True), F.col("saved_us"), F.col("md5"), F.col("set_id")]


def top_duplicates(sets: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sets with the most copies; ties by row order."""
    return sets.orderBy(F.col("copies").desc(), *set_order()).limit(k)


def scan_totals(sets: DataFrame, folder_sets: DataFrame | None = None) -> DataFrame:
    """Sets, copies and reclaimable bytes of a scan; folder columns are null when folders were skipped."""
    spare = (F.col("size_bytes") * (F.col("copies") - 1)).alias("spare")
    rows = sets.select(F.lit(True).alias("is_file"), "copies", spare)
    if folder_sets is not None:
        rows = rows.unionByName(folder_sets.select(F.lit(False).alias("is_file"), "copies", F.lit(0).alias("spare")))
    is_file = F.col("is_file")
    total = lambda which, c: F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0)).cast("bigint")
    skipped = F.lit(None).cast("bigint")
    return rows.agg(
        F.count_if(is_file).alias("file_sets"),
        total(is_file, "copies").alias("file_copies"),
        total(is_file, "spare").alias("reclaimable_bytes"),
        (skipped if folder_sets is None else F.count_if(~is_file)).alias("folder_sets"),
        (skipped if folder_sets is None else total(~is_file, "copies")).alias("folder_copies"),
    )
