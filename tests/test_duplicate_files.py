"""Duplicate files on small trees whose results follow from the rules."""

import pytest
from pyspark.sql import functions as F

from twinsieve import find_duplicate_files
from twinsieve.sources import report
from twinsieve.operators.hashing import split_by_start
from twinsieve.plans.duplicate_files import file_candidates
from twinsieve.operators.ranking import copy_rank
from twinsieve.operators.sets import from_wide, top_duplicates, wide_locations, with_locations

# (path, content, seconds after the base time): every rule decides about something in it.
TREE = [
    # Three copies, listed by depth; a name that differs in case, and in its fraction of a second.
    ("old/note.eml", "mail", 0), ("mail/2020/note.eml", "mail", 0), ("mail/2021/note.eml", "mail", 0),
    ("bak/img.PNG", "pix", 0), ("cam/IMG.png", "pix", 0.3),
    # One name, two sets and a single file; then names that agree on all but the second, or the size.
    ("p/log", "one", 0), ("q/log", "one", 0), ("r/log", "two", 0), ("s/log", "two", 0), ("t/log", "solo", 0),
    ("p/tick", "tick", 0), ("q/tick", "tick", 90), ("p/len", "ab", 0), ("q/len", "abcd", 0),
    ("{k}/a+b (1)", "plus", 0), ("{l}/a+b (1)", "plus", 0),
    # Equal trees with trees in them, one of which has a third copy elsewhere.
    ("one/Album/01.ogg", "t1", 0), ("one/Album/art/cover.png", "cc", 0), ("one/Album/live/02.ogg", "t2", 0),
    ("two/Album/01.ogg", "t1", 0), ("two/Album/art/cover.png", "cc", 0), ("two/Album/live/02.ogg", "t2", 0),
    ("three/art/cover.png", "cc", 0),
    # UTF-16 order, composed and decomposed names, folders in another script.
    ("\uff5a/gr", "gg", 0), ("\U0001f4c1/gr", "gg", 0), ("c1/\u00c5.md", "ang", 0), ("c2/A\u030a.md", "ang", 0),
    ("j1/\ud55c\uae00/k", "ko", 0), ("j2/\ud55c\uae00/k", "ko", 0),
]
FILE_SETS = sorted([
    ("note.eml", ["old", "mail/2020", "mail/2021"]), ("img.PNG", ["bak", "cam"]), ("log", ["p", "q"]), ("log", ["r", "s"]),
    ("a+b (1)", ["{k}", "{l}"]), ("01.ogg", ["one/Album", "two/Album"]), ("02.ogg", ["one/Album/live", "two/Album/live"]),
    ("cover.png", ["three/art", "one/Album/art", "two/Album/art"]), ("gr", ["\U0001f4c1", "\uff5a"]), ("\u00c5.md", ["c1", "c2"]),
    ("k", ["j1/\ud55c\uae00", "j2/\ud55c\uae00"]),
])


def test_the_tree(tree, rows_of):
    found = find_duplicate_files(tree(TREE).files)
    assert rows_of(found) == FILE_SETS
    photo = found.sets.filter("file_name = 'img.PNG'").first()
    assert (photo.copies, photo.size_bytes, photo.saved_us % 1_000_000) == (2, 3, 0)


@pytest.mark.parametrize("partitions", [1, 64])
def test_partitioning_does_not_matter(tree, rows_of, partitions):
    shuffled = tree(TREE).files.orderBy(F.xxhash64("path")).repartition(partitions)
    assert rows_of(find_duplicate_files(shuffled)) == FILE_SETS


def test_a_folder_with_two_spellings_is_listed_twice(tree, rows_of):
    rows = [("a/N.txt", "c", 0), ("a/n.txt", "c", 0), ("b/n.txt", "c", 0)]
    assert rows_of(find_duplicate_files(tree(rows).files)) == [("N.txt", ["a", "a", "b"])]


def test_dates_before_1970_and_after_2038(tree, rows_of):
    old, far = -315_000_000 - 1_715_941_800, 2_208_988_800 - 1_715_941_800
    rows = [("a/o", "1", old + 0.2), ("b/o", "1", old + 0.9), ("a/f", "1", far), ("b/f", "1", far),
            ("a/t", "1", 0), ("b/t", "1", 2)]
    assert [n for n, _ in rows_of(find_duplicate_files(tree(rows).files))] == ["f", "o"]


def test_empty_and_small_files(tree, rows_of):
    rows = [("a/e", "", 0), ("b/e", "", 0), ("a/s", "12", 0), ("b/s", "12", 0), ("a/l", "123", 0), ("b/l", "123", 0)]
    files = tree(rows).files
    assert [n for n, _ in rows_of(find_duplicate_files(files))] == ["e", "l", "s"]
    assert [n for n, _ in rows_of(find_duplicate_files(files, ignore_empty=True))] == ["l", "s"]
    assert [n for n, _ in rows_of(find_duplicate_files(files, minimum_size=3))] == ["l"]
    with pytest.raises(ValueError):
        find_duplicate_files(files, minimum_size=-1)


def test_cold_and_unreadable_files_drop_out(tree, rows_of):
    rows = [(f"{d}/f", "c", 0) for d in "abc"] + [(f"{d}/g", "c", 0) for d in "ab"] + [(f"{d}/h", "c", 0) for d in "abc"]
    files = tree(rows).files.withColumns({
        "attributes": F.when(F.col("path").isin("/data/a/f", "/data/a/g"), 0x1000).otherwise(0),
        "size_bytes": F.when(F.col("path") != "/data/a/h", F.col("size_bytes")),
        "content": F.when(F.col("path") != "/data/b/g", F.col("content")),
    })
    assert rows_of(find_duplicate_files(files, skip_cold=True)) == [("f", ["b", "c"]), ("h", ["b", "c"])]
    assert rows_of(find_duplicate_files(files)) == [("f", ["a", "b", "c"]), ("h", ["b", "c"])]


def test_cached_hashes_are_trusted_and_kept_in_upper_case(spark, tree, rows_of):
    files = tree([("a/f", "one", 0), ("b/f", "two", 0)]).files
    cache = spark.createDataFrame([("/data/a/f", "A" * 32), ("/data/b/f", "A" * 32)], "path string, md5 string")
    found = find_duplicate_files(files, hash_cache=cache)
    assert rows_of(found) == [("f", ["a", "b"])]
    assert found.sets.first().md5 == "A" * 32


def test_prefix_stage(spark, tree):
    big = lambda head, tail: head + "." * 2_000 + tail
    rows = [("a/start", big("1", ""), 0), ("b/start", big("2", ""), 0), ("a/end", big("", "1"), 0), ("b/end", big("", "2"), 0),
            ("a/same", big("", ""), 0), ("b/same", big("", ""), 0), ("a/small", "1", 0), ("b/small", "2", 0),
            ("a/known", big("1", ""), 0), ("b/known", big("2", ""), 0)]
    files = tree(rows).files
    cache = spark.createDataFrame([("/data/a/known", "A" * 32)], "path string, md5 string")
    split = split_by_start(file_candidates(files), files, cache, 100, 1_000).select("name", "start_md5").collect()
    assert sorted({r.name for r in split}) == ["end", "known", "same", "small"]
    assert {r.name for r in split if r.start_md5 is None} == {"known", "small"}
    assert len(split) == 8


def test_row_order_and_top(tree):
    rows = [(f"{d}/{n}", c, s) for d in "12" for n, c, s in
            [("a", "x", 0), ("a.txt", "x", 0), ("a.txt", "x", 60), ("a.txt", "y", 0), ("B.txt", "x", 0)][:1]]
    rows += [(f"{d}/{n}", c, s) for d, n, c, s in
             [("3", "a.txt", "x", 0), ("4", "a.txt", "x", 0), ("5", "a.txt", "x", 60), ("6", "a.txt", "x", 60),
              ("7", "B.txt", "x", 0), ("8", "B.txt", "x", 0), ("9", "B.txt", "x", 0)]]
    found = find_duplicate_files(tree(rows).files)
    from twinsieve.operators.sets import set_order

    ordered = [(r.file_name, r.saved_us) for r in found.sets.orderBy(*set_order()).collect()]
    assert [n for n, _ in ordered] == ["a", "a.txt", "a.txt", "B.txt"]
    assert ordered[1][1] < ordered[2][1]
    assert [(r.file_name, r.copies) for r in top_duplicates(found.sets, 2).collect()] == [("B.txt", 3), ("a", 2)]


def test_wide_view_and_back(tree):
    found = find_duplicate_files(tree(TREE).files)
    fixed = found.sets.select("set_id", "file_name")
    ranked = copy_rank(found.copies.df, found.copies.widest)
    wide = wide_locations(ranked, fixed)
    assert wide.columns == ["set_id", "file_name", "location_1", "location_2", "location_3"]
    back = from_wide(wide, ["set_id", "file_name"])
    assert back.count() == sum(len(locations) for _, locations in FILE_SETS)
    assert sorted(r.copies for r in wide_locations(ranked, fixed, 4).transform(lambda w: from_wide(w, ["set_id"])).filter("pos = 1").collect())[-2:] == [3, 3]
    with pytest.raises(ValueError, match="3 copies"):
        wide_locations(ranked, fixed, 2)
    assert wide_locations(ranked.limit(0), fixed).collect() == []


def test_a_set_too_wide_for_one_row_is_an_error_in_the_array_view_only(tree):
    found = find_duplicate_files(tree([(f"{d}/f", "c", 0) for d in "abc"]).files)
    assert found.copies.df.count() == 3
    with pytest.raises(Exception, match="at most 2"):
        with_locations(found.sets, found.copies.df, 2).collect()


def test_a_set_wider_than_a_spreadsheet(spark):
    files = spark.range(16_500).selectExpr(
        "concat('/r/f', id, '/n') as path", "concat('/r/f', id) as folder", "'n' as name", "1L as size_bytes", "0L as mtime_us",
        "0 as attributes", "'c' as content")
    found = find_duplicate_files(files)
    _, copies = report.file_tables(found.sets, found.copies)
    assert copies.agg(F.max("pos"), F.count("folder")).first()[:] == (16_500, 16_500)


def test_scale(spark, rows_of):
    files = spark.range(10_000).selectExpr(
        "concat('/r/t', id % 2, '/f', id % 100 div 2, '/n', id div 100, '_', id % 100 div 2) as path", "id"
    ).selectExpr("path", "regexp_extract(path, '^(.*)/', 1) as folder", "substring_index(path, '/', -1) as name",
                 "1L as size_bytes", "0L as mtime_us", "0 as attributes", "substring_index(path, '/', -1) as content")
    found = find_duplicate_files(files)
    assert (found.sets.count(), found.copies.df.count()) == (5_000, 10_000)
