"""Incremental rescan: hashes of unchanged files are taken from the previous report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_key, scan_key, sort_key
from ..functions.times import same_saved_date
from ..functions.values import valid_md5
from ..operators.lookups import folder_key
from ..session import materialize, small


def previous_hashes(
    file_copies: DataFrame, files: DataFrame, tz: str | None = None, windows_paths: bool = False
) -> DataFrame:
    """(path, md5) of scanned files that a report lists with the same size and saved second.

    ``file_copies`` is the report in long form. Folders compare exactly, or by name key with
    ``windows_paths``. Hashes that are not 32 hex digits are ignored. An edit that keeps size and
    second goes unnoticed: the report is trusted.
    """
    tz = tz or files.sparkSession.conf.get("spark.sql.session.timeZone")
    recorded = file_copies.filter(valid_md5("md5")).select(
        folder_key("folder", windows_paths).alias("folder_key"), name_key("file_name").alias("key"), "file_name",
        F.col("size_bytes").alias("recorded_size"), "local_us", "utc_offset_s", F.upper("md5").alias("md5"),
    )
    table = materialize(recorded, "recorded", measure=recorded.columns, columnar=True)
    side = F.broadcast(table.df) if small(table) else table.df
    current = files.select(
        folder_key("folder", windows_paths).alias("folder_key"), name_key("name").alias("key"),
        F.struct("path", "size_bytes", "mtime_us").alias("record"), scan_key("folder", "name").alias("met"),
    )
    # A key is a name in a folder, close to unique, so none is hot. The first file in scan order counts.
    matched = current.join(side, ["folder_key", "key"]).groupBy(*recorded.columns).agg(
        F.min_by("record", "met").alias("record")
    )
    same = (F.col("record.size_bytes") == F.col("recorded_size")) & same_saved_date(
        "record.mtime_us", "local_us", "utc_offset_s", tz
    )
    # Where several rows fit one file, the last in row order counts.
    row = F.struct(sort_key("file_name", ignore_case=True), "local_us", "md5")
    return matched.filter(same).groupBy(F.col("record.path").alias("path")).agg(F.max_by("md5", row).alias("md5"))
