"""Duplicate folders on small trees whose results follow from the rules."""

import pytest
from pyspark.sql import functions as F

from twinsieve import find_duplicate_files, find_duplicate_folders
from twinsieve.operators.filters import exclude, exclude_paths, mark_links
from twinsieve.operators.hierarchy import fingerprint, folder_base, folder_order
from twinsieve.sources.inventory import metadata

from test_duplicate_files import TREE

UNDECIDED = ["name", "content", "date", "extra", "empty", "renamed"]


def photos(folder, mark, a="a", second=0):
    """Two files, one in a sub folder; every case has contents and names of its own."""
    return [(f"{folder}/a.jpg", f"{a} {mark}", second), (f"{folder}/sub{mark}/b.jpg", f"b {mark}", 0)]


def names_of(found):
    return sorted((r.folder_name, r.copies) for r in found.sets.collect())


def test_the_tree(tree, rows_of):
    catalog = tree(TREE)
    files = find_duplicate_files(catalog.files)
    found = find_duplicate_folders(catalog.files, catalog.folders, hash_cache=files.hashes)
    assert rows_of(found, "folder_name") == sorted([
        ("Album", ["one/Album", "two/Album"]),
        ("art", ["three/art", "one/Album/art", "two/Album/art"]),
        ("\ud55c\uae00", ["j1/\ud55c\uae00", "j2/\ud55c\uae00"]),
    ])
    album = found.sets.filter("folder_name = 'Album'").first()
    assert (album.file_count, album.folder_count, album.size_bytes) == (3, 2, 6)


def test_almost_equal_folders(tree):
    """Each pair differs in one respect; only the equal sub folders below them remain."""
    rows, empty = [], []
    for mark in UNDECIDED:
        rows += photos(f"one{mark}/P{mark}", mark)
        second = f"two{mark}/P{mark}"
        if mark == "name":
            rows += photos("twoname/Other", mark)
        elif mark == "content":
            rows += photos(second, mark, a="A")
        elif mark == "date":
            rows += photos(second, mark, second=60)
        elif mark == "renamed":
            rows += [(p.replace("a.jpg", "c.jpg"), c, s) for p, c, s in photos(second, mark)]
        else:
            rows += photos(second, mark)
        if mark == "extra":
            rows.append((f"{second}/extra.txt", "more", 0))
        if mark == "empty":
            empty.append(f"{second}/more")
    catalog = tree(rows, empty)
    found = find_duplicate_folders(catalog.files, catalog.folders)
    assert names_of(found) == sorted((f"sub{mark}", 2) for mark in UNDECIDED)


def test_top_most_nested_and_empty(tree, rows_of):
    rows = []
    for folder in ("one/Photos/2024", "two/photos/2024", "three/2024", "p/Deep/er", "q/Deep/er"):
        rows += photos(folder, "d" if "er" in folder else "m")
    catalog = tree(rows, ["one/Empty/inner", "two/Empty/inner", "one/Photos/none", "two/photos/none"])
    found = find_duplicate_folders(catalog.files, catalog.folders)
    assert rows_of(found, "folder_name") == sorted([
        ("2024", ["three/2024", "one/Photos/2024", "two/photos/2024"]),
        ("Photos", ["one/Photos", "two/photos"]), ("Deep", ["p/Deep", "q/Deep"]),
    ])
    photo = found.sets.filter("folder_name = 'Photos'").first()
    assert (photo.file_count, photo.folder_count) == (2, 3)
    ordered = [r.folder_name for r in found.sets.orderBy(*folder_order()).collect()]
    assert ordered == ["2024", "Deep", "Photos"]


def test_siblings_that_differ_by_case_are_not_merged(tree):
    """A and a hold the files one way round here and the other way there."""
    one = [("one/T/A/f", "1", 0), ("one/T/a/g", "2", 0), ("one/T/a/h", "3", 0)]
    two = [("two/T/A/f", "1", 0), ("two/T/A/g", "2", 0), ("two/T/a/h", "3", 0)]
    catalog = tree(one + two)
    assert names_of(find_duplicate_folders(catalog.files, catalog.folders)) == []


def test_unprovable_folders(spark, tree):
    rows = []
    for mark in ("unreadable", "report", "link", "cold", "gone", "fine", "nohash"):
        rows += photos(f"one/P{mark}", mark) + photos(f"two/P{mark}", mark)
    rows.append(("one/Preport/report.dat", "r", 0))
    catalog = tree(rows, links=["one/Plink/link"], unreadable=["two/Punreadable/subunreadable"])
    catalog = exclude_paths(catalog, spark.createDataFrame([("/data/one/Preport/report.dat",)], "path string"))
    at = lambda path: F.col("path") == f"/data/{path}"
    files = catalog.files.withColumns({
        "attributes": F.when(at("two/Pcold/a.jpg"), 0x400000).otherwise(0),
        "size_bytes": F.when(~at("two/Pgone/a.jpg"), F.col("size_bytes")),
        "content": F.when(~at("two/Pnohash/a.jpg"), F.col("content")),
    })
    found = find_duplicate_folders(files, catalog.folders, skip_cold=True)
    expected = [("Pfine", 2)] + [(f"sub{m}", 2) for m in ("cold", "gone", "link", "nohash", "report")]
    assert names_of(found) == sorted(expected)


def test_names_left_out_do_not_count(tree):
    rows = []
    for side in ("one", "two"):
        rows += photos(f"{side}/Photos", "m")
        rows += [(f"{side}/Photos/Thumbs.db", side, 0), (f"{side}/Photos/.cache/{side}.bin", side, 0)]
    catalog = tree(rows, links=["one/Photos/.Cache2"])
    plain = find_duplicate_folders(catalog.files, catalog.folders)
    assert names_of(plain) == [("subm", 2)]
    kept = exclude(catalog, ["thumbs.DB", ".cache*"], ["/data"])
    assert names_of(find_duplicate_folders(kept.files, kept.folders)) == [("Photos", 2)]


def test_the_scan_root_is_never_left_out(tree):
    catalog = tree([("sub/data/f", "c", 0), ("g", "c", 0)])
    kept = exclude(catalog, ["data"], ["/data"])
    assert sorted(r.path for r in kept.files.collect()) == ["/data/g"]
    assert sorted(r.path for r in kept.folders.collect()) == ["/data", "/data/sub"]


def test_link_column(spark):
    folders = spark.createDataFrame(
        [("/a", True, None, False), ("/a/l", True, None, True)], "path string, readable boolean, reason string, is_link boolean"
    )
    assert [(r.path, r.readable, r.reason) for r in mark_links(folders).orderBy("path").collect()] == [
        ("/a", True, None), ("/a/l", False, "link")
    ]


def test_only_unhashed_files_below_candidates_are_hashed(tree, monkeypatch):
    from twinsieve.operators import hashing

    wanted = []
    plain = hashing.content_hashes
    monkeypatch.setattr(hashing, "content_hashes", lambda files, table, *a: wanted.append(
        sorted(r.path for r in table.df.collect())) or plain(files, table, *a))
    catalog = tree(photos("one/P", "m") + photos("two/P", "m") + [("one/other", "x", 0)])
    files = find_duplicate_files(catalog.files)
    find_duplicate_folders(catalog.files, catalog.folders, hash_cache=files.hashes)
    assert [len(w) for w in wanted] == [4]


@pytest.mark.parametrize("per_job", [1, 2, 7])
def test_levels_per_job_do_not_matter(tree, per_job):
    catalog = tree(TREE + [("x/1/2/3/4/5/f", "c", 0)])
    base = folder_base(metadata(catalog.files), catalog.folders)
    rows = lambda table: sorted((r.path, r.fingerprint, r.file_count, r.folder_count, r.size_bytes) for r in table.df.collect())
    found = rows(fingerprint(base, per_job))
    assert found == rows(fingerprint(base, 4))
    root = next(r for r in found if r[0] == "/data")
    assert root[2] == len(TREE) + 1


def test_no_folders(tree):
    catalog = tree([("f", "c", 0)])
    found = find_duplicate_folders(catalog.files, catalog.folders)
    assert found.sets.count() == 0 and found.copies.df.count() == 0
