"""Validate a report against a current catalog, without reading contents."""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import join_path
from ..functions.times import local_utc_offset, saved_second
from ..operators.groups import join_groups, lookup
from ..operators.hierarchy import folder_rollup
from ..operators.lookups import (
    CHANGED, MISSING, PRESENT, UNAVAILABLE, copy_state, folder_key, folder_listing, folder_state, lookup_copy, measured_roots,
    root_of_path,
)
from ..operators.ranking import copy_rank
from ..session import Table, materialize, together
from ..sources.inventory import Catalog
from ..sources.report import Report, read_report, write_report


def copy_states(
    file_copies: DataFrame, catalog: Catalog, roots: DataFrame | Table, tz: str, windows_paths: bool = False
) -> DataFrame:
    """Each recorded file copy with its ``state``."""
    found = lookup_copy(file_copies, catalog.files, windows_paths).withColumn("folder_key", folder_key("folder", windows_paths))
    listing = folder_listing(catalog.folders, windows_paths)
    listed = lookup(found, listing, ["folder_key"], ["set_id", "pos"], "left")
    rooted = root_of_path(listed, roots, "folder")
    return rooted.select(*file_copies.columns, copy_state(tz).alias("state"))


def folder_copy_states(
    folder_copies: DataFrame,
    catalog: Catalog,
    roots: DataFrame | Table,
    patterns: Sequence[str] = (),
    windows_paths: bool = False,
) -> DataFrame:
    """Each recorded folder copy with its ``state``: unchanged counts and size of its whole tree."""
    keyed = folder_copies.withColumn("folder_key", folder_key("folder", windows_paths))
    recorded = materialize(keyed.select("folder_key").distinct(), "recorded-folders", measure=["folder_key"])
    counted = ("file_count", "folder_count", "size_bytes", "readable")
    now = folder_rollup(catalog.files, catalog.folders, patterns, recorded, windows_paths).select(
        folder_key("path", windows_paths).alias("folder_key"), "path", *[F.col(c).alias(f"now_{c}") for c in counted]
    )
    joined = keyed.join(now, "folder_key", "left")
    if windows_paths:
        # Two spellings of one folder may be catalogued: the recorded one counts, else the first in order.
        found = F.struct(*[f"now_{c}" for c in counted])
        first = F.min_by(found, F.struct(F.col("path") != F.col("folder"), "path"))
        joined = joined.groupBy(*keyed.columns).agg(first.alias("found")).select(*keyed.columns, "found.*")
    listed = joined
    rooted = root_of_path(listed, roots, "folder")
    return rooted.select(*folder_copies.columns, folder_state().alias("state"))


_REMOVED = (MISSING, CHANGED)


def row_outcomes(sets: DataFrame, states: DataFrame) -> DataFrame:
    """Per set: copies checked, surviving, removed and unavailable. Unavailable copies survive."""
    state = F.col("state")
    counted = states.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(state.isin(PRESENT, UNAVAILABLE)).alias("surviving"),
        F.count_if(state.isin(*_REMOVED)).alias("removed"),
        F.count_if(state == UNAVAILABLE).alias("unavailable"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sets.select("set_id").join(counted, "set_id", "left").select(
        "set_id", *[zero(c) for c in ("checked", "surviving", "removed", "unavailable")]
    )


def _written_outcomes(sets: DataFrame, states: DataFrame) -> Table:
    return materialize(row_outcomes(sets, states), "row-outcomes", extremes="surviving", counters=outcome_counters())


def surviving_rows(sets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sets that keep at least two copies, with ``copies`` recomputed."""
    kept = outcomes.filter("surviving >= 2").select("set_id", F.col("surviving").alias("copies"))
    return sets.drop("copies").join(kept, "set_id")


def surviving_copies(states: Table, rows: DataFrame, widest: int) -> DataFrame:
    """Present and unavailable copies of surviving rows, numbered again."""
    kept = states.df.filter(F.col("state").isin(PRESENT, UNAVAILABLE)).drop("state", "pos")
    groups = rows.select("set_id", F.col("copies").alias("group_rows"))
    joined = join_groups(kept, groups, ["set_id"], ["folder"], "inner", states.rows).withColumnRenamed("group_rows", "copies")
    return copy_rank(joined.withColumn("path", F.col("folder")), widest).drop("path")


def removed_copies(states: DataFrame, location_is_item: bool = False) -> DataFrame:
    """Log of copies that were removed, and of those kept because they cannot be reached."""
    path = F.col("folder") if location_is_item else join_path("folder", "file_name")
    return states.filter(F.col("state") != PRESENT).select(
        "set_id", path.alias("path"), "state", (F.col("state") != UNAVAILABLE).alias("removed")
    )


_COUNTERS = ("rows_checked", "copies_checked", "copies_removed", "copies_unavailable", "rows_removed", "rows_remaining")


def outcome_counters() -> list[Column]:
    """What is counted of ``row_outcomes``, under the names of the summary."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counted = (
        F.count(F.lit(1)), total("checked"), total("removed"), total("unavailable"), F.count_if(F.col("surviving") < 2),
        F.count_if(F.col("surviving") >= 2),
    )
    return [column.alias(name) for column, name in zip(counted, _COUNTERS)]


def validation_summary(spark: SparkSession, outcomes: Table, folder_outcomes: Table | None = None) -> DataFrame:
    """One row of counters; the folder counters stay 0 when the report has no folder tables.

    They were observed while the outcomes were written, so the outcomes are not read again.
    """
    both = [("", outcomes.seen), ("folder_", folder_outcomes.seen if folder_outcomes else {})]
    row = {f"{prefix}{name}": seen.get(name) or 0 for prefix, seen in both for name in _COUNTERS}
    row["changed"] = any(value > 0 for name, value in row.items() if name.endswith(("copies_removed", "rows_removed")))
    kinds = {name: "boolean" if name == "changed" else "bigint" for name in row}
    return spark.range(0, 1, 1, 1).select(*[F.lit(value).cast(kinds[name]).alias(name) for name, value in row.items()])


class Validation(NamedTuple):
    """``summary`` (one row), the surviving tables, the log, and the version written (None if none)."""

    summary: DataFrame
    report: Report
    removed: DataFrame
    version: int | None


def validate(
    spark: SparkSession,
    report_dir: str,
    catalog: Catalog,
    roots: DataFrame,
    dry_run: bool = False,
    tz: str | None = None,
    windows_paths: bool = False,
) -> Validation:
    """Classify every recorded copy, drop what is gone and publish a new version if anything changed.

    The report's settings are kept; names they leave out are left out of the folder check. Rows from
    before the offset column get the offset of their local time when they are rewritten.
    """
    tz = tz or spark.conf.get("spark.sql.session.timeZone")
    report, roots = read_report(spark, report_dir), measured_roots(roots)

    def check_files() -> tuple[Table, Table]:
        checked = copy_states(report.file_copies, catalog, roots, tz, windows_paths)
        states = materialize(checked, "copy-states", columnar=True)
        return states, _written_outcomes(report.file_sets, states.df)

    def check_folders() -> tuple[Table, Table] | None:
        if report.folder_sets is None:
            return None
        patterns = report.settings.exclude_names
        checked = folder_copy_states(report.folder_copies, catalog, roots, patterns, windows_paths)
        states = materialize(checked, "folder-states")
        return states, _written_outcomes(report.folder_sets, states.df)

    (states, outcomes), of_folders = together(check_files, check_folders)
    removed = removed_copies(states.df)
    folder_states, folder_outcomes = of_folders or (None, None)
    if folder_states is not None:
        removed = removed.unionByName(removed_copies(folder_states.df, location_is_item=True))
    summary = validation_summary(spark, outcomes, folder_outcomes)

    file_sets = surviving_rows(report.file_sets, outcomes.df)
    file_copies = surviving_copies(states, file_sets, outcomes.most or 0)
    folder_sets = folder_copies = None
    if folder_states is not None:
        folder_sets = surviving_rows(report.folder_sets, folder_outcomes.df)
        folder_copies = surviving_copies(folder_states, folder_sets, folder_outcomes.most or 0)
    kept = report._replace(
        file_sets=file_sets, file_copies=file_copies, folder_sets=folder_sets, folder_copies=folder_copies
    )
    version = None
    if not dry_run and summary.first()["changed"]:
        offset = F.coalesce("utc_offset_s", local_utc_offset(saved_second("local_us"), tz))
        version = write_report(
            spark, report_dir,
            file_sets.withColumn("utc_offset_s", offset), file_copies.withColumn("utc_offset_s", offset),
            folder_sets, folder_copies, report.settings,
        )
    return Validation(summary, kept, removed, version)
