"""The registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload import oracle
from workload.queries import REGISTRY
from check import TABLES, rows_of as in_order

SF = "/root/testdata/sf0.001"
# The quick ones; check.py runs them all.
QUICK = [
    "catalog_files", "exclude_files", "exclude_folders", "excluded_links", "minimum_size", "links_tainted", "valid_md5",
    "duplicate_files", "folder_rollup", "folder_scope", "provable_folders", "fn_name_key", "fn_upper_simple", "fn_sort_key",
    "fn_path_parts", "fn_ancestors", "fn_wildcard_regex", "fn_utc_offset", "fn_local_utc_offset", "fn_offset_text",
    "fn_same_saved_date", "fn_parse_size", "fn_md5", "scan_settings",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) == set(oracle.statements()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.sql(entry.oracle_sql()[name])
    assert in_order(df.columns, [tuple(r) for r in df.collect()]) == in_order(result.columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 374
