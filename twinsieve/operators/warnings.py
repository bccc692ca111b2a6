"""What a scan had to skip, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import split_cold, split_unreadable
from .hashing import GROUP
from .groups import keep_repeated
from .sets import name_groups


def scan_warnings(metadata: DataFrame, folders: DataFrame, hashes: DataFrame, skip_cold: bool = False) -> DataFrame:
    """(kind, path, reason) for everything skipped while matching files.

    ``hashes`` has a row (path) for each candidate with a hash, or with first bytes that no other has. Only files that reached a stage can be skipped by it: a
    file without size or time is reported when another has its name, a cold file or one without a
    hash when another agrees on name, second and size. With ``skip_cold`` cold files appear as one
    row with their number.
    """
    row = lambda kind, path, reason: [F.lit(kind).alias("kind"), path.alias("path"), reason.alias("reason")]
    path, nowhere = F.col("path"), F.lit(None).cast("string")
    unlisted = folders.filter(~F.col("readable")).groupBy("path").agg(
        F.coalesce(F.min("reason"), F.lit("not readable")).alias("reason")
    ).select(*row("folder", path, F.col("reason")))
    repeated = name_groups(metadata)
    unreadable = split_unreadable(repeated)
    unknown = unreadable.skipped.select(*row("file", path, F.lit("size or time cannot be read")))
    agreeing = keep_repeated(unreadable.kept, GROUP, ["path"])
    parts = [unlisted, unknown]
    if skip_cold:
        cold = split_cold(agreeing)
        number = cold.skipped.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        text = F.concat(F.col("n").cast("string"), F.lit(" cold files were not checked"))
        parts.append(number.select(*row("cold", nowhere, text)))
        agreeing = keep_repeated(cold.kept, GROUP, ["path"])
    unhashed = agreeing.join(hashes.select("path"), "path", "left_anti")
    parts.append(unhashed.select(*row("hash", path, F.lit("content cannot be read"))))
    return reduce(DataFrame.unionByName, parts)
