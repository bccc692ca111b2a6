"""The report: a folder of versioned Parquet tables, published as a whole."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import partial
from typing import Collection, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import pattern_problem
from ..functions.times import MICROS
from ..operators.groups import join_groups
from ..operators.ranking import copy_rank
from ..operators.sets import Copies
from ..session import together
from .publishing import Conflict, children, claim, delete, is_published, publish, read_published

FILE_SETS_SCHEMA = (
    "set_id string, file_name string, local_us bigint, utc_offset_s int, size_bytes bigint, md5 string, copies bigint"
)
FILE_COPIES_SCHEMA = (
    "set_id string, pos bigint, folder string, file_name string, local_us bigint, utc_offset_s int, "
    "size_bytes bigint, md5 string"
)
FOLDER_SETS_SCHEMA = (
    "set_id string, folder_name string, file_count bigint, folder_count bigint, size_bytes bigint, copies bigint"
)
FOLDER_COPIES_SCHEMA = (
    "set_id string, pos bigint, folder string, folder_name string, file_count bigint, folder_count bigint, "
    "size_bytes bigint"
)
_SCHEMAS = {
    "file_sets": FILE_SETS_SCHEMA,
    "file_copies": FILE_COPIES_SCHEMA,
    "folder_sets": FOLDER_SETS_SCHEMA,
    "folder_copies": FOLDER_COPIES_SCHEMA,
}
_PUBLISHED = "_PUBLISHED"
_CLAIMED = "_CLAIMED"
BUCKET = "bucket"
BUCKET_ROWS = 1_000_000  # rows of a table that go to one file, about
_BUCKETED = ("file_sets", "file_copies")
_VERSION = re.compile(r"^v=(\d+)$")


@dataclass
class ScanSettings:
    """What a scan left out; stored with its report and applied again when that is validated."""

    exclude_names: list[str] = field(default_factory=list)
    minimum_size: int = 0


class Touched(NamedTuple):
    """The buckets of a report that a write gives anew, and the version that has the others."""

    buckets: Collection[int]
    version: int | None


class Report(NamedTuple):
    """Set tables and their long copies. The folder tables are None when folders were skipped,
    and empty when none were found. Without ``utc_offset_s`` a row's time is only known as local."""

    file_sets: DataFrame
    file_copies: DataFrame
    folder_sets: DataFrame | None
    folder_copies: DataFrame | None
    settings: ScanSettings
    warnings: DataFrame | None = None


def versions(spark: SparkSession, report_dir: str) -> list[int]:
    """Published versions, oldest first. Unpublished ones are leftovers of a failed write, or still being written."""
    return [n for n in _numbers(spark, report_dir) if is_published(spark, f"{report_dir}/v={n}/{_PUBLISHED}")]


def _numbers(spark: SparkSession, report_dir: str) -> list[int]:
    return sorted(int(m.group(1)) for m in map(_VERSION.match, children(spark, report_dir)) if m)


def _taken(spark: SparkSession, report_dir: str) -> int:
    """The highest number that a writer has claimed; with an older layout, an empty marker counts."""
    claimed = (n for n in reversed(_numbers(spark, report_dir)) if {_CLAIMED, _PUBLISHED} & {*children(spark, f"{report_dir}/v={n}")})
    return next(claimed, 0)


def published(spark: SparkSession, report_dir: str, version: int) -> dict:
    """What a version's marker says: the folder and names of its tables, the buckets' folders, and its label."""
    return read_published(spark, f"{report_dir}/v={version}/{_PUBLISHED}")


def prune(spark: SparkSession, report_dir: str, keep: int) -> list[int]:
    """Delete all but the last ``keep`` published versions and the leftovers of failed writes below them.

    Buckets that a kept version has from an earlier one stay.
    """
    if keep < 1:
        raise ValueError(f"At least one version is kept, not {keep}.")
    known = versions(spark, report_dir)
    gone = [n for n in _numbers(spark, report_dir) if n < known[-keep]] if len(known) > keep else []
    parts = (published(spark, report_dir, n).get("parts") or {} for n in known[-keep:])
    used = {folder for tables in parts for folders in tables.values() for folder in folders.values()}
    deleted = []
    for n in gone:
        if not any(folder.startswith(f"v={n}/") for folder in used):
            delete(spark, f"{report_dir}/v={n}")
            deleted.append(n)
        elif n in known:
            # Without its marker it is no version any more; tables go folder by folder.
            delete(spark, f"{report_dir}/v={n}/{_PUBLISHED}")
            deleted.append(n)
        for own in children(spark, f"{report_dir}/v={n}"):
            for table in _SCHEMAS:
                for bucket in children(spark, f"{report_dir}/v={n}/{own}/{table}"):
                    if f"v={n}/{own}/{table}/{bucket}" not in used:
                        delete(spark, f"{report_dir}/v={n}/{own}/{table}/{bucket}")
    return deleted


def report_exists(spark: SparkSession, report_dir: str) -> bool:
    return bool(versions(spark, report_dir))


def file_tables(sets: DataFrame, copies: Copies) -> tuple[DataFrame, DataFrame]:
    """File sets and their copies, ranked, in the report's shape.

    Times are local beside their offset, as they are read. Copies repeat their set's columns, so
    validating and reusing hashes needs no join of the two.
    """
    local = (F.col("saved_us") + F.col("utc_offset_s").cast("bigint") * MICROS).alias("local_us")
    rows = sets.select("set_id", "file_name", local, "utc_offset_s", "size_bytes", "md5", "copies")
    return rows, _with_set_columns(copies, rows)


def folder_tables(sets: DataFrame, copies: Copies) -> tuple[DataFrame, DataFrame]:
    """Folder sets and their copies, ranked, in the report's shape."""
    rows = sets.select("set_id", "folder_name", "file_count", "folder_count", "size_bytes", "copies")
    return rows, _with_set_columns(copies, rows)


def _with_set_columns(copies: Copies, sets: DataFrame) -> DataFrame:
    ranked = copy_rank(copies.df, copies.widest).select("set_id", "pos", "folder")
    groups = sets.withColumnRenamed("copies", "group_rows")
    joined = join_groups(ranked, groups, ["set_id"], ["pos"], "inner", copies.rows)
    return joined.drop("group_rows")


def write_report(
    spark: SparkSession,
    report_dir: str,
    file_sets: DataFrame,
    file_copies: DataFrame,
    folder_sets: DataFrame | None = None,
    folder_copies: DataFrame | None = None,
    settings: ScanSettings | None = None,
    label: dict | None = None,
    touched: Touched | None = None,
) -> int:
    """Write all tables of a new version, then publish it with a marker, and return its number.

    Tables go to a folder of their own, which the marker names together with the tables that belong to it:
    what a failed write has left is never seen. The marker is written aside and renamed, so it is seen whole or
    not at all. A published version is never written again; if another writer has published since this one
    began, or claims the same number first, this one fails with ``Conflict``. A number that a crashed writer has claimed is
    left out. Tables are in the shapes of the ``*_SCHEMA`` constants; ``label`` is kept with the version.

    With ``touched``, file tables have a ``bucket`` column and only the rows of those buckets; all other buckets
    are taken over from the version named there, without being read.
    """
    settings = settings or ScanSettings()
    if settings.minimum_size < 0:
        raise ValueError(f"minimum_size is negative: {settings.minimum_size}.")
    base = max(versions(spark, report_dir), default=0)
    version = max(base, _taken(spark, report_dir)) + 1
    own = uuid.uuid4().hex
    folder = f"{report_dir}/v={version}/{own}"
    tables = {"file_sets": file_sets, "file_copies": file_copies}
    if folder_sets is not None:
        tables.update(folder_sets=folder_sets, folder_copies=folder_copies)
    bucketed = _BUCKETED if touched else ()

    def write(name: str) -> None:
        columns = [column.split()[0] for column in _SCHEMAS[name].split(", ")]
        if name in bucketed:
            write_buckets(tables[name].select(*columns, BUCKET), f"{folder}/{name}")
        else:
            tables[name].select(*columns).write.parquet(f"{folder}/{name}")

    together(*[partial(write, name) for name in tables], lambda: write_settings(spark, folder, settings))
    parts = {}
    for name in bucketed:
        earlier = {} if touched.version is None else published(spark, report_dir, touched.version)["parts"][name]
        parts[name] = {k: at for k, at in earlier.items() if int(k) not in touched.buckets}
        parts[name] |= {k: f"v={version}/{own}/{name}/{BUCKET}={k}" for k in written_buckets(spark, f"{folder}/{name}")}
    if max(versions(spark, report_dir), default=0) != base:
        raise Conflict(f"Another writer has published at '{report_dir}' meanwhile.")
    claim(spark, f"{report_dir}/v={version}/{_CLAIMED}")
    publish(spark, f"{report_dir}/v={version}/{_PUBLISHED}", {"folder": own, "tables": sorted(tables), "label": label, "parts": parts})
    return version


def write_buckets(rows: DataFrame, folder: str) -> None:
    """Rows in a folder for each ``bucket``. A bucket's rows are dealt over as many tasks as they need, so a name that many
    files have goes to several."""
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != BUCKET]), F.col("share")).cast("int")
    sizes = rows.groupBy(BUCKET).agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).alias("share"))
    # One row for each bucket.
    dealt = rows.join(F.broadcast(sizes), BUCKET).withColumn("share", spread)
    dealt.repartition(BUCKET, "share").drop("share").write.mode("overwrite").partitionBy(BUCKET).parquet(folder)


def written_buckets(spark: SparkSession, folder: str) -> list[str]:
    """The numbers of the buckets that are there, as texts."""
    return [name.split("=")[1] for name in children(spark, folder) if name.startswith(f"{BUCKET}=")]


def read_buckets(spark: SparkSession, schema: str, folders: Sequence[str]) -> DataFrame:
    """The rows of buckets' folders; a folder that is not there is an error."""
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def report_buckets(spark: SparkSession, report_dir: str, version: int, name: str, buckets: Collection[int]) -> DataFrame:
    """The rows of a version's table that are in the given buckets."""
    parts = published(spark, report_dir, version)["parts"][name]
    return read_buckets(spark, _SCHEMAS[name], [f"{report_dir}/{at}" for k, at in sorted(parts.items()) if int(k) in buckets])


def write_settings(spark: SparkSession, folder: str, settings: ScanSettings) -> None:
    """Settings as (setting, value) rows."""
    rows = [("exclude_name", p) for p in settings.exclude_names]
    if settings.minimum_size > 0:
        rows.append(("minimum_size", str(settings.minimum_size)))
    spark.createDataFrame(rows, "setting string, value string").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/settings"
    )


def checked_settings(stored: DataFrame) -> DataFrame:
    """Stored settings with ``problem``: why a value is ignored, or null.

    A pattern must be able to match a name; a smallest size must be a whole number of bytes.
    """
    value = F.trim("value")
    number = F.when(F.rlike(value, F.lit(r"^[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?$")), value.try_cast("double"))
    whole = (number >= 0) & (number < F.lit(2.0**63)) & (number == F.floor(number))
    size_problem = F.when(~F.coalesce(whole, F.lit(False)), F.lit("not a whole number of bytes"))
    problem: Column = F.when(F.col("setting") == "exclude_name", pattern_problem("value")).when(
        F.col("setting") == "minimum_size", size_problem
    )
    return stored.select("setting", "value", problem.alias("problem"))


def read_settings(spark: SparkSession, folder: str) -> tuple[ScanSettings, DataFrame]:
    """The usable settings, and warnings about the others. Settings are a handful of rows."""
    checked = checked_settings(spark.read.schema("setting string, value string").parquet(f"{folder}/settings"))
    settings = ScanSettings()
    for row in checked.filter("problem is null").collect():
        if row["setting"] == "exclude_name":
            settings.exclude_names.append(row["value"])
        else:
            settings.minimum_size = int(float(row["value"]))
    warnings = checked.filter("problem is not null").select(
        F.lit("setting").alias("kind"), F.col("value").alias("path"), F.col("problem").alias("reason")
    )
    return settings, warnings


def read_report(spark: SparkSession, report_dir: str, version: int | None = None) -> Report:
    """A published version, the last one by default. Reports made before the offset column have null offsets."""
    known = versions(spark, report_dir)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"There is no report at '{report_dir}'" + (f" with version {version}." if known else "."))
    number = version or known[-1]
    marker = published(spark, report_dir, number)
    base = f"{report_dir}/v={number}/{marker['folder']}"

    parts = marker.get("parts") or {}

    def table(name: str) -> DataFrame:
        if name in parts:
            return read_buckets(spark, _SCHEMAS[name], [f"{report_dir}/{at}" for _, at in sorted(parts[name].items())])
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{base}/{name}")

    has_folders = "folder_sets" in marker["tables"]
    settings, warnings = read_settings(spark, base)
    return Report(
        table("file_sets"),
        table("file_copies"),
        table("folder_sets") if has_folders else None,
        table("folder_copies") if has_folders else None,
        settings,
        warnings,
    )
