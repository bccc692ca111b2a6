"""Column functions, against values worked out from the rules."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinsieve.functions import names, paths, times, values


def column(spark, data, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def path_column(spark, data, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, p string")
    return [r[1] for r in df.select("i", make("p").alias("x")).orderBy("i").collect()]


def test_name_key_composes_and_folds_one_character_at_a_time(spark):
    given = ["a.txt", "cafe\u0301", "caf\u00e9", "straße", "strasse", "日本語.txt", "привет", "\U0001F600x", "ŉx", "مرحبا"]
    expected = ["A.TXT", "CAF\u00c9", "CAF\u00c9", "STRAßE", "STRASSE", "日本語.TXT", "ПРИВЕТ", "\U0001F600X", "ŉX", "مرحبا"]
    assert column(spark, given, names.name_key) == expected


def test_upper_simple_does_not_compose(spark):
    assert column(spark, ["cafe\u0301", "ﬁ"], names.upper_simple) == ["CAFE\u0301", "ﬁ"]


def test_sort_key_orders_by_utf16_units(spark):
    emoji, wide = column(spark, ["\U0001F600", "\uFF21"], names.sort_key)
    assert bytes(emoji) < bytes(wide)
    lower, upper = column(spark, ["b", "A"], lambda c: names.sort_key(c, ignore_case=True))
    assert bytes(upper) < bytes(lower)


def test_location_order(spark):
    given = ["/r/z", "/r/a/b/c", "/r/a/b", "/r/B", "/r/a/C/c"]
    df = spark.createDataFrame([(p,) for p in given], "p string").orderBy(*names.location_order("p"))
    assert [r.p for r in df.collect()] == ["/r/B", "/r/z", "/r/a/b", "/r/a/b/c", "/r/a/C/c"]


def test_scan_order_is_depth_first_with_files_before_sub_folders(spark):
    given = [("/a", "z"), ("/a/b", "a"), ("/a/b/c", "a"), ("/a-b", "a"), ("/a/\uFF21", "a"), ("/a/\U0001F600", "a")]
    df = spark.createDataFrame(reversed(given), "f string, n string").orderBy(names.scan_key("f", "n"))
    expected = [("/a", "z"), ("/a/b", "a"), ("/a/b/c", "a"), ("/a/\U0001F600", "a"), ("/a/\uFF21", "a"), ("/a-b", "a")]
    assert [tuple(r) for r in df.collect()] == expected


@pytest.mark.parametrize(
    "pattern, matching, other",
    [
        ("*.tmp", ["a.tmp", "A.TMP", ".tmp"], ["a.tmpx", "tmp"]),
        ("r?.txt", ["r1.txt", "r\U0001F600.txt"], ["r.txt", "r12.txt"]),
        ("café*", ["CAFE\u0301.jpg"], ["cafe.jpg"]),
        ("a.b", ["A.B"], ["axb"]),
        ("[x]", ["[X]"], ["x"]),
        ("a*b*c", ["abc", "aXbYc", "abbc"], ["acb", "ab"]),
        ("*ab*ab", ["abab", "xabyab"], ["ab", "xab"]),
        ("*", ["", "anything", "two\nlines"], []),
        ("%_", ["%_"], ["ab"]),
    ],
)
def test_wildcards(spark, pattern, matching, other):
    found = column(spark, matching + other, lambda c: names.matches_any(names.name_key(c), [pattern]))
    assert found == [True] * len(matching) + [False] * len(other)


def test_wildcards_never_backtrack_exponentially(spark):
    start = time.time()
    pattern = "*".join(["", *"aaaaaaaa", "b"])
    assert column(spark, ["a" * 200], lambda c: names.matches_any(names.name_key(c), [pattern])) == [False]
    assert time.time() - start < 5


@pytest.mark.parametrize("pattern", ["", "a/b", "a\\b"])
def test_patterns_that_match_no_name_are_rejected(pattern):
    with pytest.raises(ValueError):
        names.matches_pattern("name", pattern)


def test_paths(spark):
    given = ["/a/b", "/a", "/", "C:\\a\\b", "C:\\a", "s3://bucket/a/b", "/a:b/c"]
    assert path_column(spark, given, paths.base_name) == ["b", "a", "", "b", "a", "b", "c"]
    assert path_column(spark, given, paths.parent_of) == ["/a", "/", "/", "C:\\a", "C:\\", "s3://bucket/a", "/a:b"]
    assert path_column(spark, given, paths.ancestors) == [
        ["/", "/a", "/a/b"], ["/", "/a"], ["/"], ["C:\\", "C:\\a", "C:\\a\\b"], ["C:\\", "C:\\a"],
        ["s3://bucket", "s3://bucket/a", "s3://bucket/a/b"], ["/", "/a:b", "/a:b/c"],
    ]
    assert path_column(spark, ["C:\\a\\b", "/home/a/", "//server/share/a"], paths.path_depth) == [3, 2, 3]
    assert path_column(spark, ["/", "/a", "C:\\", "C:\\a"], lambda p: paths.join_path(p, "'n'")) == [
        "/n", "/a/n", "C:\\n", "C:\\a\\n",
    ]


def test_saved_second_rounds_down(spark):
    given = [1_500_000, -500_000, -1_000_000, 0, -315_619_200_000_001, 2_208_988_800_999_999]
    assert column(spark, given, times.saved_second, "bigint") == [1, -1, -1, 0, -315_619_201, 2_208_988_800]


def test_offsets(spark):
    text = ["+10:00", "-04:30", "+00:19:32", "-00:00:01"]
    seconds = [36_000, -16_200, 1_172, -1]
    assert column(spark, seconds, times.offset_text, "int") == text
    assert column(spark, text, lambda c: times.parse_offset(c, "r")) == seconds
    with pytest.raises(PySparkException, match="'r' is not a usable report: 'noon'"):
        column(spark, ["noon"], lambda c: times.parse_offset(c, "r"))


def test_offset_of_repeated_and_skipped_wall_times(spark):
    wall = [1_710_036_000 + 1_800, 1_730_595_600 + 1_800, 1_720_000_000, 1_735_000_000]  # 2:30 skipped, 1:30 twice
    offset = column(spark, wall, lambda c: times.local_utc_offset(c, "America/New_York"), "bigint")
    assert offset == [-18_000, -18_000, -14_400, -18_000]


def test_same_saved_date_compares_instants_or_wall_times(spark):
    us = 1_730_615_400_000_000  # 2024-11-03 06:30 UTC, the second 1:30 in New York
    df = spark.createDataFrame(
        [(us, us - 18_000 * 10**6 + 900_000, -18_000), (us, us - 14_400 * 10**6, -18_000), (us, us - 18_000 * 10**6, None)],
        "m bigint, l bigint, o int",
    )
    same = df.select(times.same_saved_date("m", "l", "o", "America/New_York").alias("x")).collect()
    assert [r.x for r in same] == [True, False, True]


def test_sizes(spark):
    given = ["0", "1.5MB", "2kb", "0.5", "1.5", "2.5", "1PB", "8192PB", "8191PB", "-1", "1 MB", "1TBs", "1e3", ""]
    expected = [0, 1_572_864, 2_048, 0, 2, 2, 1 << 50, None, 8191 << 50, None, None, None, None, None]
    assert column(spark, given, values.parse_size) == expected


def test_hashes_and_attributes(spark):
    assert column(spark, ["abc", ""], values.md5_hex) == ["900150983CD24FB0D6963F7D28E17F72", "D41D8CD98F00B204E9800998ECF8427E"]
    assert column(spark, ["abcd"], lambda c: values.md5_hex(c, 3)) == ["900150983CD24FB0D6963F7D28E17F72"]
    assert column(spark, ["0" * 32, "g" * 32, "0" * 31, None], values.valid_md5) == [True, False, False, False]
    assert column(spark, [0, 0x1000, 0x40000, 0x400000, 0x20], values.is_cold, "int") == [False, True, True, True, False]
