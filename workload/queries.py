"""One query per operator, over the given tables or the catalog derived from them.

Each takes (spark, sf_dir) and returns a DataFrame; ``oracle`` has the SQL for the same names.
"""

from __future__ import annotations

import functools
import os
import uuid
from typing import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve import find_duplicate_files, find_duplicate_folders, read_report, scan, scan_tree, validate
from twinsieve.functions import names, paths, times, values
from twinsieve.operators import filters, groups, hashing, hierarchy, lookups, ranking, sets, tree_sums, warnings
from twinsieve.plans import duplicate_files as file_plan
from twinsieve.plans import duplicate_folders as folder_plan
from twinsieve.plans import validate as validation
from twinsieve.plans.rescan import previous_hashes
from twinsieve.session import Table, materialize, shared_dir
from twinsieve.sources import content, inventory, report
from twinsieve.streaming.rescan import start_rescans

from . import derived
from .derived import FIRST_BYTES, LARGE_BYTES, ROOTS, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

UTC, INDIA, NEW_YORK = "UTC", "Asia/Kolkata", "America/New_York"
FILE_PATTERNS = ["d1?.TXT", "*5.txt"]
FOLDER_PATTERNS = ["SRC1*", "b3"]
COLD = values.ATTRIBUTE_RECALL_ON_OPEN


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.removesuffix("_query")] = fn
    return fn


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/twinsieve/{uuid.uuid4().hex}-{label}"


def found_files(spark: SparkSession, sf: str, tz: str = UTC):
    return find_duplicate_files(derived.files(spark, sf), tz=tz)


def hashed(spark: SparkSession, sf: str) -> Table:
    files = derived.files(spark, sf)
    return file_plan.hashed_candidates(files, file_plan.file_candidates(files))


def recorded(spark: SparkSession, sf: str, tz: str = UTC) -> tuple[DataFrame, DataFrame]:
    """The report tables of the derived catalog."""
    found = found_files(spark, sf, tz)
    return report.file_tables(found.sets, found.copies)


def recorded_folders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = find_duplicate_folders(derived.files(spark, sf), derived.folders(spark, sf))
    return report.folder_tables(found.sets, found.copies)


# ---------------------------------------------------------------- sources and sinks


@query
def catalog_files(spark, sf):
    listing = derived.files(spark, sf).select(
        "path", F.concat("size_bytes", F.lit("")).alias("size_bytes"), F.timestamp_micros("mtime_us").alias("mtime")
    )
    return inventory.canonical_files(listing)


@query
def catalog_folders(spark, sf):
    return inventory.folders_of(derived.files(spark, sf)).select("path", "readable")


@query
def scan_tree_query(spark, sf):
    """The derived catalog written as a file tree by the executors, then listed."""
    root = scratch(spark, "tree").removeprefix("file:")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, mtime in zip(batch["path"], batch["content"], batch["mtime_us"]):
                at = root + path
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as out:
                    out.write(content)
                os.utime(at, ns=(mtime * 1000, mtime * 1000))
            yield pd.DataFrame({"path": batch["path"]})

    materialize(derived.files(spark, sf).select("path", "content", "mtime_us").mapInPandas(write, "path string"), "tree")
    catalog, _ = scan_tree(spark, root, exclude_names=["b3"])
    below = F.substring("path", F.lit(len(root) + 1), F.char_length("path"))
    listed = catalog.files.select(below.alias("path"), "size_bytes", "mtime_us")
    nothing = F.lit(None).cast("bigint")
    folders = catalog.folders.filter(F.col("path") != root)
    return listed.unionByName(folders.select(below.alias("path"), nothing.alias("size_bytes"), nothing.alias("mtime_us")))


@query
def report_roundtrip(spark, sf):
    at = scratch(spark, "report")
    report.write_report(spark, at, *recorded(spark, sf, INDIA))
    return read_report(spark, at).file_sets.drop("set_id")


@query
def report_read(spark, sf):
    at = scratch(spark, "report")
    report.write_report(spark, at, *recorded(spark, sf), *recorded_folders(spark, sf))
    back = read_report(spark, at)
    files = back.file_copies.select("file_name", "md5", "pos", "folder")
    return files.unionByName(
        back.folder_copies.select(F.col("folder_name").alias("file_name"), F.lit(None).alias("md5"), "pos", "folder")
    )


@query
def scan_settings(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    rows = [
        docs.select(F.lit("exclude_name").alias("setting"), F.concat("lang", F.lit("*")).alias("value")),
        pages.select(F.lit("exclude_name").alias("setting"), F.col("url").alias("value")),
        pages.select(F.lit("exclude_name").alias("setting"), F.regexp_extract("url", "#.*$", 0).alias("value")),
        docs.select(F.lit("minimum_size").alias("setting"), F.col("n_chars").cast("string").alias("value")),
        docs.select(F.lit("minimum_size").alias("setting"), F.concat("n_chars", F.lit(".5")).alias("value")),
        docs.select(F.lit("minimum_size").alias("setting"), F.concat(F.lit("-"), "n_chars").alias("value")),
        docs.select(F.lit("minimum_size").alias("setting"), F.concat("n_chars", F.lit("_000")).alias("value")),
        docs.select(F.lit("minimum_size").alias("setting"), F.concat("n_chars", F.lit("e2")).alias("value")),
    ]
    stored = rows[0]
    for more in rows[1:]:
        stored = stored.unionByName(more)
    return report.checked_settings(stored.distinct())


@query
def locations_wide(spark, sf):
    found = found_files(spark, sf)
    fixed = found.sets.select("set_id", "file_name", "size_bytes", "md5")
    return sets.wide_locations(ranking.copy_rank(found.copies.df, found.copies.widest), fixed).drop("set_id")


@query
def locations_unpivot(spark, sf):
    found = found_files(spark, sf)
    fixed = found.sets.select("set_id", "file_name", "md5")
    wide = sets.wide_locations(ranking.copy_rank(found.copies.df, found.copies.widest), fixed)
    # A blank in the middle, as an edited report may have.
    gap = F.when(F.pmod(F.octet_length("location_2"), F.lit(2)) == 0, F.col("location_2")).otherwise("")
    return sets.from_wide(wide.withColumn("location_2", gap), ["set_id", "file_name", "md5"]).drop("set_id")


def _flawed(spark, sf) -> DataFrame:
    """The derived files with sizes, contents and attributes missing here and there."""
    doc, live = F.col("doc_id"), F.col("root") == "live"
    files = derived.files(spark, sf)
    return files.withColumns({
        "size_bytes": F.when(~(live & (doc % 37 == 0)), F.col("size_bytes")),
        "content": F.when(~((F.col("root") == "backup") & (doc % 41 == 0)), F.col("content")),
        "attributes": F.when(live & (doc % 43 == 0), F.lit(COLD)).otherwise(F.col("attributes")),
    })


def _marked(spark, sf) -> DataFrame:
    """The derived folders with some marked unreadable."""
    bad = F.col("path").endswith("/b1")
    return derived.folders(spark, sf).select(
        "path", (~bad).alias("readable"), F.when(bad, F.lit("unlistable")).alias("reason")
    )


@query
def scan_warnings(spark, sf):
    files = _flawed(spark, sf)
    found = find_duplicate_files(files, skip_cold=True)
    return warnings.scan_warnings(inventory.metadata(files), _marked(spark, sf), found.hashes, skip_cold=True)


@query
def scan_job_warnings(spark, sf):
    flawed = inventory.Catalog(_flawed(spark, sf), _marked(spark, sf))
    return scan(spark, flawed, skip_cold=True, include_folders=False, tz=UTC).skipped


# ---------------------------------------------------------------- filters


@query
def exclude_files(spark, sf):
    return filters.exclude_names(derived.files(spark, sf), FILE_PATTERNS).select("path")


@query
def exclude_folders(spark, sf):
    kept = filters.exclude_folders(derived.catalog(spark, sf), FOLDER_PATTERNS + ["live"], ROOTS)
    return kept.files.select(F.lit("file").alias("kind"), "path").unionByName(
        kept.folders.select(F.lit("folder").alias("kind"), "path")
    )


@query
def excluded_links(spark, sf):
    """A link left out by name does not mark its parent; another link does."""
    linked = derived.folders(spark, sf).withColumn("is_link", F.col("path").rlike("/b[23]$"))
    catalog = inventory.Catalog(derived.files(spark, sf), linked)
    kept = filters.exclude_folders(catalog, ["b3"], ROOTS)
    tainted = hierarchy.tainted_folders(filters.mark_links(kept.folders), kept.files)
    return hierarchy.provable_folders(kept.folders, tainted)


@query
def minimum_size(spark, sf):
    return filters.min_size(derived.files(spark, sf), 1_000, ignore_empty=True).select("path", "size_bytes")


def _own(spark, sf) -> DataFrame:
    return derived.files(spark, sf).filter("root = 'live' and doc_id % 50 = 0").select("path")


@query
def exclude_paths(spark, sf):
    kept = filters.exclude_paths(derived.catalog(spark, sf), _own(spark, sf))
    files = kept.files.select("path", F.lit(None).cast("boolean").alias("readable"))
    return files.unionByName(hierarchy.folder_readable(kept.folders))


@query
def links_tainted(spark, sf):
    linked = derived.folders(spark, sf).withColumn("is_link", F.col("path").endswith("/b2"))
    return filters.mark_links(linked)


@query
def skip_cold(spark, sf):
    cold = F.when(F.col("doc_id") % 3 == 0, F.lit(COLD)).when(F.col("doc_id") % 5 == 0, F.lit(2)).otherwise(0)
    backup = F.when(F.col("root") == "backup", cold).otherwise(0)
    files = derived.files(spark, sf).withColumn("attributes", backup)
    return file_plan.file_candidates(files, skip_cold=True).select("path", "attributes")


@query
def unreadable_files(spark, sf):
    split = filters.split_unreadable(_flawed(spark, sf))
    rows = lambda df, known: df.select("path", F.lit(known).alias("known"))
    return rows(split.kept, True).unionByName(rows(split.skipped, False))


@query
def valid_md5(spark, sf):
    doc, md5 = F.col("doc_id"), F.md5("text")
    edited = (
        F.when(doc % 5 == 0, F.substring(md5, 1, 31)).when(doc % 7 == 0, F.translate(md5, "a", "g"))
        .when(doc % 11 == 0, F.concat(md5, F.lit("0"))).when(doc % 3 == 0, F.upper(md5)).otherwise(md5)
    )
    docs = table(spark, sf, "documents").select("doc_id", edited.alias("md5"))
    return docs.filter(values.valid_md5("md5")).select("doc_id", F.upper("md5").alias("md5"))


# ---------------------------------------------------------------- joins


@query
def files_in_folders(spark, sf):
    known = derived.folders(spark, sf).filter(~F.col("path").endswith("/b0"))
    return hierarchy.files_in_folders(inventory.metadata(derived.files(spark, sf)), known).select("path", "folder")


@query
def folder_children(spark, sf):
    known = derived.folders(spark, sf).filter("path not like '%/src1'")
    return hierarchy.folder_children(known)


@query
def folder_scope(spark, sf):
    known = derived.folders(spark, sf)
    return hierarchy.folder_scope(known, known.filter("path like '%/src1' or path = '/archive'").select("path"))


def _reused(spark, sf) -> DataFrame:
    _, copies = recorded(spark, sf)
    return previous_hashes(copies, derived.later(spark, sf).files, UTC)


@query
def reuse_md5(spark, sf):
    return _reused(spark, sf)


@query
def hash_workload(spark, sf):
    candidates = file_plan.file_candidates(derived.later(spark, sf).files)
    return hashing.hash_workload(candidates, _reused(spark, sf)).select("path")


@query
def lookup_copy(spark, sf):
    _, copies = recorded(spark, sf)
    return lookups.lookup_copy(copies, derived.later(spark, sf).files).select(
        "file_name", "folder", "md5", "found_name", "now_size", "now_us"
    )


@query
def root_of_path(spark, sf):
    top = derived.roots(spark, sf).unionByName(
        derived.folders(spark, sf).filter("path like '/live/%' and path not like '/live/%/%'")
        .select(F.col("path").alias("root"), F.lit(True).alias("reachable"))
    )
    return lookups.root_of_path(derived.files(spark, sf).select("path"), top)


@query
def lookup_folder(spark, sf):
    _, copies = recorded_folders(spark, sf)
    later = derived.later(spark, sf)
    now = hierarchy.folder_rollup(later.files, later.folders).select(
        F.col("path").alias("folder"), F.col("file_count").alias("now_file_count"),
        F.col("folder_count").alias("now_folder_count"), F.col("size_bytes").alias("now_size_bytes"),
    )
    return copies.drop("set_id", "pos").join(now, "folder", "left")


# ---------------------------------------------------------------- grouping stages


@query
def name_groups(spark, sf):
    return sets.name_groups(inventory.metadata(derived.files(spark, sf))).select("path", "name_key")


@query
def date_size_groups(spark, sf):
    return file_plan.file_candidates(derived.files(spark, sf)).select("path", "name_key", "saved_s", "size_bytes")


@query
def start_hash_split(spark, sf):
    files = derived.files(spark, sf)
    candidates = file_plan.file_candidates(files)
    return hashing.split_by_start(
        candidates, files, _start_cache(files), FIRST_BYTES, LARGE_BYTES
    ).select("path", "start_md5")


def _start_cache(files: DataFrame) -> DataFrame:
    """Hashes known already: their groups pass the prefix stage as they are."""
    known = files.filter("root = 'live' and doc_id % 4 = 0")
    return known.select("path", values.md5_hex("content").alias("md5"))


@query
def md5_groups(spark, sf):
    rows = hashed(spark, sf)
    return groups.keep_repeated(rows.df, [*hashing.GROUP, "md5"], ["path"], rows.rows).select("path", "md5")


@query
def hash_files(spark, sf):
    files = derived.later(spark, sf).files
    candidates = materialize(file_plan.file_candidates(files).select("path"), "candidates", ["path"], columnar=True)
    return hashing.hash_files(candidates, files, _reused(spark, sf))


@query
def duplicate_files(spark, sf):
    found = found_files(spark, sf, INDIA)
    return report.file_tables(found.sets, found.copies)[1].drop("set_id")


@query
def duplicate_files_objects(spark, sf):
    """The contents as objects of their own: first bytes and whole contents are read by path."""
    root = scratch(spark, "objects")
    files = derived.files(spark, sf)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                system, at = content.located(root + path)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(text.encode())
            yield batch.select(["path"])

    materialize(files.select("path", "content").mapInArrow(write, "path string"), "objects")
    listed = files.drop("content").withColumn("path", F.concat(F.lit(root), "path"))
    found = find_duplicate_files(listed, tz=UTC, first_bytes=FIRST_BYTES, first_bytes_min=LARGE_BYTES)
    return report.file_tables(found.sets, found.copies)[1].drop("set_id")


@query
def duplicate_copies(spark, sf):
    found = found_files(spark, sf)
    named = found.sets.select("set_id", "file_name", "size_bytes", "md5")
    return ranking.copy_rank(found.copies.df, found.copies.widest).join(named, "set_id").drop("set_id", "copies")


@query
def scan_totals(spark, sf):
    done = scan(spark, derived.catalog(spark, sf), tz=UTC)
    return done.totals


@query
def scan_totals_files_only(spark, sf):
    done = scan(spark, derived.catalog(spark, sf), include_folders=False, ignore_empty=True, tz=UTC)
    return done.totals


@query
def folder_readable(spark, sf):
    kept = filters.exclude_paths(inventory.Catalog(derived.files(spark, sf), _marked(spark, sf)), _own(spark, sf))
    return hierarchy.folder_readable(kept.folders)


# ---------------------------------------------------------------- ranking and order


@query
def copy_rank(spark, sf):
    """Folders grouped by name, each group's folders numbered by location."""
    known = derived.folders(spark, sf).select(paths.base_name("path").alias("set_id"), F.col("path").alias("folder"), "path")
    counted = known.join(groups.group_counts(known, ["set_id"]).withColumnRenamed("group_rows", "copies"), "set_id")
    return ranking.copy_rank(counted, None).select(F.col("set_id").alias("name"), "pos", "folder")


@query
def ordered_sets(spark, sf):
    found = found_files(spark, sf).sets
    return ranking.rank_sliced(found, sets.set_order(), "rank").select("rank", "file_name", "saved_us", "md5")


@query
def ordered_folders(spark, sf):
    found = find_duplicate_folders(derived.files(spark, sf), derived.folders(spark, sf)).sets
    return ranking.rank_sliced(found, hierarchy.folder_order(), "rank").select(
        "rank", "folder_name", "size_bytes", "first_location"
    )


@query
def top_duplicates(spark, sf):
    return sets.top_duplicates(found_files(spark, sf).sets, 10).select("file_name", "saved_us", "md5", "copies")


# ---------------------------------------------------------------- folders


@query
def tainted_folders(spark, sf):
    files = _flawed(spark, sf)
    unhashed = files.filter("content is null").select("folder")
    return hierarchy.tainted_folders(_marked(spark, sf), files, unhashed)


@query
def provable_folders(spark, sf):
    tainted = hierarchy.tainted_folders(_marked(spark, sf), _flawed(spark, sf))
    return hierarchy.provable_folders(derived.folders(spark, sf), tainted)


def _with_twin(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints have a format of their own; what counts is which folders share one."""
    twins = fingerprints.groupBy("fingerprint").agg(F.min("path").alias("first_equal"))
    return fingerprints.join(twins, "fingerprint", "left").drop("fingerprint", "level", "name_key", "set_id")


@query
def folder_fingerprint(spark, sf):
    return _with_twin(folder_plan.cheap_fingerprints(derived.files(spark, sf), derived.folders(spark, sf)).df)


@query
def folder_fingerprint_delta(spark, sf):
    """Fingerprints of the later snapshot, from those of the first and what has changed."""
    (files, folders), (later, later_folders) = (
        (inventory.metadata(c.files), c.folders.select("path", "readable")) for c in (derived.catalog(spark, sf), derived.later(spark, sf))
    )
    first = tree_sums.update_tree(None, tree_sums.file_changes(files).unionByName(tree_sums.folder_changes(folders)))
    state = materialize(tree_sums.next_state(None, first), "tree-state", columnar=True).df
    changes = [
        of(rows, sign)
        for of, before, after in ((tree_sums.file_changes, files, later), (tree_sums.folder_changes, folders, later_folders))
        for sign, rows in zip((-1, 1), tree_sums.changed_rows(before, after))
    ]
    update = tree_sums.update_tree(state, functools.reduce(DataFrame.unionByName, changes))
    return _with_twin(tree_sums.fingerprints_in(tree_sums.next_state(state, update)))


@query
def folder_rollup(spark, sf):
    return hierarchy.folder_rollup(derived.files(spark, sf), derived.folders(spark, sf))


@query
def repeated_name_scope(spark, sf):
    return hierarchy.repeated_name_scope(derived.folders(spark, sf))


@query
def folder_candidates(spark, sf):
    cheap = folder_plan.cheap_fingerprints(derived.files(spark, sf), derived.folders(spark, sf))
    return hierarchy.folder_candidates(cheap.df, cheap.rows).select("path", "name_key", "file_count")


@query
def folder_sets_all(spark, sf):
    files = derived.files(spark, sf)
    members = folder_plan.confirmed_members(files, folder_plan.folder_tree_candidates(files, derived.folders(spark, sf))).df
    first = members.groupBy("set_id").agg(F.min("path").alias("first_equal"))
    return members.join(first, "set_id").select("path", "first_equal", "file_count", "folder_count", "size_bytes")


def _shown(found) -> DataFrame:
    return report.folder_tables(found.sets, found.copies)[1].drop("set_id")


@query
def duplicate_folders(spark, sf):
    return _shown(find_duplicate_folders(derived.files(spark, sf), derived.folders(spark, sf)))


@query
def duplicate_folders_spelt(spark, sf):
    """Paths with empty parts in them, as object stores allow: one folder, however it is spelt."""
    twice = F.when(F.col("doc_id") % 2 == 0, F.replace("path", F.lit("/b"), F.lit("//b"))).otherwise(F.col("path"))
    listing = derived.files(spark, sf).select(twice.alias("path"), "size_bytes", "mtime_us", "content")
    files = inventory.canonical_files(listing)
    return _shown(find_duplicate_folders(files, inventory.folders_of(files)))


@query
def duplicate_folders_excl(spark, sf):
    kept = filters.exclude(derived.catalog(spark, sf), FILE_PATTERNS + ["b3"], ROOTS)
    return _shown(find_duplicate_folders(kept.files, kept.folders))


@query
def duplicate_folders_cold(spark, sf):
    cold = (F.col("root") == "live") & (F.col("doc_id") % 13 == 5)
    files = derived.files(spark, sf).withColumn("attributes", F.when(cold, F.lit(COLD)).otherwise(0))
    return _shown(find_duplicate_folders(files, derived.folders(spark, sf), skip_cold=True))


# ---------------------------------------------------------------- functions


@query
def fn_name_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.name_key("text").alias("name_key"))


@query
def fn_upper_simple(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", names.upper_simple("text").alias("upper_text"))


@query
def fn_sort_key(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.hex(names.sort_key("url")).alias("exact"), F.hex(names.sort_key("url", True)).alias("folded")
    )


@query
def fn_path_depth(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.path_depth("url").alias("depth"))


@query
def fn_path_parts(spark, sf):
    return derived.files(spark, sf).select(
        "path", paths.base_name("path").alias("base"), paths.parent_of("path").alias("parent"),
        paths.parent_of("folder").alias("above"), paths.join_path("folder", "name").alias("joined"),
    )


@query
def fn_ancestors(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(paths.ancestors("url")).alias("level", "ancestor"))


@query
def fn_wildcard_regex(spark, sf):
    key = names.name_key("p_name")
    patterns = {"runs": "*l*?e*", "anchored": "?L*", "exact": "small ring", "ends": "b*t", "many": "*a*a*e*n*"}
    return table(spark, sf, "part").select(
        "p_partkey", *[names.matches_any(key, [p]).alias(label) for label, p in patterns.items()]
    )


def _instants(spark, sf) -> DataFrame:
    """Event times moved over the year and, for some, before 1970."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 366) * (86_400 * times.MICROS)
    early = F.when(F.col("event_id") % 7 == 0, 2_000_000_000 * times.MICROS).otherwise(0)
    return table(spark, sf, "events").select("event_id", (micros - early).cast("bigint").alias("us"))


@query
def fn_saved_second(spark, sf):
    return _instants(spark, sf).select("event_id", times.saved_second("us").alias("second"))


@query
def fn_utc_offset(spark, sf):
    return _instants(spark, sf).select("event_id", times.utc_offset(times.saved_second("us"), NEW_YORK).alias("offset_s"))


@query
def fn_local_utc_offset(spark, sf):
    """Wall times of a year, quarter hours apart, so both changes of the clock are met."""
    base = derived.EPOCH_US // times.MICROS
    wall = (F.lit(base) + (F.col("event_id") % 35_136) * 900).cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", times.local_utc_offset(wall, NEW_YORK).alias("offset_s")
    )


@query
def fn_offset_text(spark, sf):
    seconds = ((F.col("event_id") * 37) % 100_000 - 50_000).cast("int")
    text = times.offset_text(seconds)
    return table(spark, sf, "events").select(
        "event_id", text.alias("offset_text"), times.parse_offset(text, "events").alias("parsed_s")
    )


@query
def fn_same_saved_date(spark, sf):
    event, us = F.col("event_id"), F.col("us")
    jitter = F.when(event % 3 == 0, 400_000).when(event % 3 == 1, -400_000).otherwise(1_000_000)
    offset = F.when(event % 2 == 0, F.lit(19_800)).cast("int")
    rows = _instants(spark, sf).select(
        "event_id", "us", offset.alias("offset"), (us + 19_800 * times.MICROS + jitter).alias("local_us")
    )
    return rows.select("event_id", times.same_saved_date("us", "local_us", "offset", INDIA).alias("same"))


@query
def fn_parse_size(spark, sf):
    doc = F.col("doc_id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "kb", "MB", "Gb", "TB", "PB", "B", " KB")]), (doc % 8 + 1).cast("int"))
    text = F.concat("n_chars", F.when(doc % 3 == 0, F.lit(".5")).otherwise(""), unit)
    docs = table(spark, sf, "documents").select("doc_id", text.alias("size_text"))
    return docs.withColumn("size_bytes", values.parse_size("size_text"))


@query
def fn_md5(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", values.md5_hex("text").alias("full_md5"), values.md5_hex("text", FIRST_BYTES).alias("start_md5")
    )


# ---------------------------------------------------------------- validation and rescans


@query
def copy_states(spark, sf):
    _, copies = recorded(spark, sf)
    states = validation.copy_states(copies, derived.later(spark, sf), derived.roots(spark, sf), UTC)
    return states.select("file_name", "folder", "md5", "state")


@query
def folder_copy_states(spark, sf):
    _, copies = recorded_folders(spark, sf)
    states = validation.folder_copy_states(copies, derived.later(spark, sf), derived.roots(spark, sf))
    return states.select("folder_name", "folder", "state")


def _validated(spark, sf):
    at = scratch(spark, "report")
    scan(spark, derived.catalog(spark, sf), at, tz=UTC)
    return validate(spark, at, derived.later(spark, sf), derived.roots(spark, sf), tz=UTC), at


@query
def removed_copies(spark, sf):
    return _validated(spark, sf)[0].removed.drop("set_id")


@query
def validate_rows(spark, sf):
    done, at = _validated(spark, sf)
    return read_report(spark, at).file_sets.select("file_name", "size_bytes", "md5", "copies")


@query
def validate_copies(spark, sf):
    done, at = _validated(spark, sf)
    back = read_report(spark, at)
    return back.file_copies.select("file_name", "md5", "pos", "folder").unionByName(
        back.folder_copies.select(F.col("folder_name").alias("file_name"), F.lit(None).alias("md5"), "pos", "folder")
    )


@query
def validate_summary(spark, sf):
    return _validated(spark, sf)[0].summary


@query
def incremental_rescan(spark, sf):
    """A later snapshot against the report of the first: unchanged files keep their hash by trust."""
    at = scratch(spark, "report")
    scan(spark, derived.catalog(spark, sf), at, include_folders=False, tz=UTC)
    doc = F.col("doc_id")
    later = derived.later(spark, sf)
    edited = later.files.withColumn("content", F.when(doc % 6 == 0, F.reverse("content")).otherwise(F.col("content")))
    done = scan(spark, later._replace(files=edited), at, include_folders=False, tz=UTC)
    return done.files.sets.drop("set_id")


@query
def rescan_stream(spark, sf):
    """The derived catalog arriving as two drops; the second overlaps the first."""
    drops, state, at = scratch(spark, "drops"), scratch(spark, "state"), scratch(spark, "report")
    files = derived.files(spark, sf)
    schema = (
        "path string, folder string, name string, size_bytes bigint, mtime_us bigint, attributes int, content string"
    )
    checkpoint = scratch(spark, "stream")
    for which in ("root <> 'backup'", "root = 'backup' or doc_id % 2 = 0"):
        files.filter(which).drop("doc_id", "root").write.mode("append").parquet(drops)
        start_rescans(spark, drops, schema, state, at, checkpoint, tz=UTC).awaitTermination()
    return read_report(spark, at).file_sets.drop("set_id")


@query
def rescan_stream_deletions(spark, sf):
    """Three drops: the live files with the archive, the backup, and deletions; few buckets."""
    drops, state, at, checkpoint = scratch(spark, "drops"), scratch(spark, "state"), scratch(spark, "report"), scratch(spark, "stream")
    files = derived.files(spark, sf)
    schema = (
        "path string, folder string, name string, size_bytes bigint, mtime_us bigint, attributes int, content string, deleted boolean"
    )
    for which, gone in (("root <> 'backup'", False), ("root = 'backup'", False), ("root = 'live' and doc_id % 5 = 0", True)):
        files.filter(which).withColumn("deleted", F.lit(gone)).drop("doc_id", "root").write.mode("append").parquet(drops)
        start_rescans(spark, drops, schema, state, at, checkpoint, tz=UTC, buckets=16).awaitTermination()
    return read_report(spark, at).file_sets.drop("set_id")
