import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402
from support import SAVED_US  # noqa: E402

from twinsieve import build_session  # noqa: E402
from twinsieve.sources.inventory import Catalog  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g", spark__python__sql__dataFrameDebugging__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def tree(spark):
    """Make a catalog from (relative path, content, seconds after SAVED) rows, as if under /data."""

    def make(rows, empty_folders=(), links=(), unreadable=(), root="/data"):
        listed = [
            (f"{root}/{path}", content, SAVED_US + int(round(offset * 1_000_000)), len(content.encode()))
            for path, content, offset in rows
        ]
        schema = "path string, content string, mtime_us bigint, size_bytes bigint"
        files = spark.createDataFrame(listed, schema).selectExpr(
            "path", "substring_index(path, '/', -1) as name",
            "left(path, char_length(path) - char_length(substring_index(path, '/', -1)) - 1) as folder",
            "size_bytes", "mtime_us", "0 as attributes", "content",
        )
        folders = {root}
        for path in [p for p, *_ in listed] + [f"{root}/{f}/x" for f in (*empty_folders, *unreadable)]:
            parent = os.path.dirname(path)
            while len(parent) >= len(root):
                folders.add(parent)
                parent = os.path.dirname(parent)
        bad = {f"{root}/{p}" for p in unreadable}
        listed_folders = [(f, f not in bad, "unlistable" if f in bad else None) for f in sorted(folders)]
        listed_folders += [(f"{root}/{p}", False, "link") for p in links]
        return Catalog(files, spark.createDataFrame(listed_folders, "path string, readable boolean, reason string"))

    return make


@pytest.fixture
def rows_of():
    """Sets as sorted (name, [locations below /data]) pairs."""

    def read(found, name="file_name"):
        from twinsieve.operators.sets import with_locations

        shown = with_locations(found.sets, found.copies.df, 1_000).select(name, "locations")
        cut = F.transform("locations", lambda p: F.regexp_replace(p, "^/data/", ""))
        return sorted((r[0], list(r[1])) for r in shown.select(name, cut).collect())

    return read
