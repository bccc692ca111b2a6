"""Catalog source: inventory tables brought into one shape."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import name_key
from ..functions.paths import ancestors, base_name, parent_of, plain_folder
from ..functions.times import saved_second
from ..functions.values import parse_size

FILES_SCHEMA = (
    "path string, folder string, name string, size_bytes bigint, mtime_us bigint, attributes int"
)
FOLDERS_SCHEMA = "path string, readable boolean, reason string"

# Why a folder is not readable.
UNLISTABLE, LINK, EXCLUDED_FILE = "unlistable", "link", "excluded file"


class Catalog(NamedTuple):
    """``files`` (with an optional ``content`` column) and ``folders``."""

    files: DataFrame
    folders: DataFrame


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def load_catalog(
    spark: SparkSession, files_path: str, folders_path: str | None = None, fmt: str = "parquet"
) -> Catalog:
    """Read a Parquet, CSV or JSON inventory; folders are derived when none are listed."""
    files = canonical_files(_read(spark, files_path, fmt))
    if folders_path is None:
        return Catalog(files, folders_of(files))
    return Catalog(files, canonical_folders(_read(spark, folders_path, fmt)))


def canonical_files(raw: DataFrame) -> DataFrame:
    """Any listing with a path becomes a ``files`` relation.

    Sizes may be numbers or texts such as ``1.5MB``; times may be microseconds (``mtime_us``) or a
    timestamp (``mtime``). What cannot be read is null.
    """
    have, types = set(raw.columns), dict(raw.dtypes)

    def given(column: str, otherwise: Column) -> Column:
        return F.col(column) if column in have else otherwise

    size = given("size_bytes", F.lit(None).cast("bigint"))
    if types.get("size_bytes") == "string":
        size = parse_size(size)
    mtime = F.unix_micros(F.col("mtime").cast("timestamp")) if "mtime" in have else F.lit(None)
    if "folder" not in have:
        raw = raw.withColumn("folder", parent_of("path"))
    columns = [
        F.col("path"),
        # Folders are compared as texts: one spelling each, also where a path has empty parts.
        plain_folder("folder").alias("folder"),
        given("name", base_name("path")).alias("name"),
        size.cast("bigint").alias("size_bytes"),
        given("mtime_us", mtime).try_cast("bigint").alias("mtime_us"),
        F.coalesce(given("attributes", F.lit(0)).try_cast("int"), F.lit(0)).alias("attributes"),
    ]
    return raw.select(*columns, *(["content"] if "content" in have else []))


def canonical_folders(raw: DataFrame) -> DataFrame:
    """``folders`` rows; a link is never followed, so it counts as unreadable."""
    have = set(raw.columns)
    readable = F.col("readable").cast("boolean") if "readable" in have else F.lit(True)
    reason = F.col("reason") if "reason" in have else F.when(~readable, F.lit(UNLISTABLE))
    if "is_link" in have:
        link = F.coalesce(F.col("is_link").cast("boolean"), F.lit(False))
        readable, reason = readable & ~link, F.when(link, F.lit(LINK)).otherwise(reason)
    return raw.select(plain_folder("path").alias("path"), readable.alias("readable"), reason.cast("string").alias("reason"))


def folders_of(files: DataFrame) -> DataFrame:
    """Every folder that an inventory of files implies, all readable.

    Folders are made distinct before their ancestors are exploded.
    """
    folders = files.select("folder").distinct().select(F.explode(ancestors("folder")).alias("path"))
    return folders.filter(F.col("path") != "/").distinct().select(
        "path", F.lit(True).alias("readable"), F.lit(None).cast("string").alias("reason")
    )


def metadata(files: DataFrame, **more: Column) -> DataFrame:
    """Everything matching needs but the content: the columns a metadata scan reads, and ``more``."""
    return files.select(
        "path", "folder", "name", "size_bytes", "mtime_us", "attributes",
        name_key("name").alias("name_key"),
        saved_second("mtime_us").alias("saved_s"),
        *[column.alias(name) for name, column in more.items()],
    )
