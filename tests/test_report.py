"""Reports: writing, reading, validating and reusing them."""

import pytest
from pyspark.sql import functions as F

from twinsieve import ScanSettings, previous_hashes, read_report, scan, validate, write_report
from twinsieve.plans.validate import copy_states, folder_copy_states, outcome_counters, row_outcomes, validation_summary
from twinsieve.session import materialize
from twinsieve.sources import publishing, report
from twinsieve.sources.inventory import Catalog

from support import SAVED_US
from test_duplicate_files import TREE


@pytest.fixture
def roots(spark):
    return spark.createDataFrame([("/data", True), ("/offline", False)], "root string, reachable boolean")


def file_rows(spark, rows):
    """Report copies from (set, name, folder, seconds, offset, size, md5)."""
    made = [(s, i, folder, name, SAVED_US + int(sec * 1e6), off, size, md5)
            for i, (s, name, folder, sec, off, size, md5) in enumerate(rows, 1)]
    return spark.createDataFrame(made, report.FILE_COPIES_SCHEMA)


def sets_of(copies):
    keys = [c for c in copies.columns if c not in ("pos", "folder")]
    return copies.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def test_round_trip_keeps_offsets_fractions_and_settings(spark, tmp_path):
    at = f"file:{tmp_path}/r"
    copies = file_rows(spark, [("1", "a", "/x", 0.25, 36_000, 5, "A" * 32), ("1", "a", "/y", 0.25, 36_000, 5, "A" * 32),
                               ("2", "b", "/x", 1, -16_200, 6, "B" * 32), ("2", "b", "/y", 1, -16_200, 6, "B" * 32)])
    assert not report.report_exists(spark, at)
    write_report(spark, at, sets_of(copies), copies, settings=ScanSettings(["*.tmp", "cache"], 3))
    back = read_report(spark, at)
    assert sorted(map(tuple, back.file_copies.collect())) == sorted(map(tuple, copies.collect()))
    assert back.folder_sets is None and back.folder_copies is None
    assert back.settings == ScanSettings(["*.tmp", "cache"], 3)
    with pytest.raises(ValueError):
        write_report(spark, at, sets_of(copies), copies, settings=ScanSettings(minimum_size=-1))


def test_no_folder_table_differs_from_an_empty_one(spark, tree, tmp_path):
    at = f"file:{tmp_path}/r"
    catalog = tree([("a/f", "c", 0), ("b/f", "c", 0)])
    scan(spark, catalog, at)
    assert read_report(spark, at).folder_sets.count() == 0
    scan(spark, catalog, at, include_folders=False)
    assert read_report(spark, at).folder_sets is None


def test_an_unpublished_version_is_not_seen(spark, tree, tmp_path):
    at = f"file:{tmp_path}/r"
    catalog = tree([("a/f", "c", 0), ("b/f", "c", 0)])
    scan(spark, catalog, at)
    spark.range(1).write.parquet(f"{at}/v=2/file_sets")  # a write that failed half way
    assert report.versions(spark, at) == [1]
    assert read_report(spark, at).file_sets.count() == 1
    with pytest.raises(FileNotFoundError):
        read_report(spark, f"{at}/none")


def test_unusable_settings_are_ignored_with_a_warning(spark, tmp_path):
    at = f"file:{tmp_path}"
    spark.createDataFrame(
        [("exclude_name", "ok*"), ("exclude_name", "a/b"), ("minimum_size", "1.5"), ("minimum_size", "1e3")],
        "setting string, value string",
    ).write.parquet(f"{at}/settings")
    settings, warned = report.read_settings(spark, at)
    assert settings == ScanSettings(["ok*"], 1_000)
    assert sorted(r.path for r in warned.collect()) == ["1.5", "a/b"]


def test_dry_run_and_rehash(spark, tree, tmp_path):
    at = f"file:{tmp_path}/r"
    catalog = tree([("a/f", "one", 0), ("b/f", "one", 0)])
    assert scan(spark, catalog, at, dry_run=True).version is None
    assert not report.report_exists(spark, at)
    scan(spark, catalog, at, ignore_empty=True)
    assert read_report(spark, at).settings.minimum_size == 1
    edited = catalog._replace(files=catalog.files.withColumn("content", F.when(F.col("path") == "/data/b/f", "two").otherwise("one")))
    assert scan(spark, edited, at).files.sets.count() == 1, "same size and second: the report is trusted"
    assert scan(spark, edited, at, rehash=True).files.sets.count() == 0


def test_previous_hashes(spark, tree):
    files = tree([("a/F.txt", "abc", 0.7), ("a/f.txt", "abc", 0), ("b/f.txt", "abc", 0), ("c/f.txt", "abc", 5),
                  ("d/f.txt", "abcd", 0), ("e/f.txt", "abc", 0)]).files
    copies = file_rows(spark, [("1", "f.txt", f"/data/{d}", 0, 0, 3, "a" * 32) for d in "abcdz"] +
                       [("2", "f.txt", "/data/e", 0, 0, 3, "not a hash")])
    found = {r.path: r.md5 for r in previous_hashes(copies, files).collect()}
    assert found == {"/data/a/F.txt": "A" * 32, "/data/b/f.txt": "A" * 32}
    upper = copies.withColumn("folder", F.upper("folder"))
    assert previous_hashes(upper, files).count() == 0
    assert previous_hashes(upper, files, windows_paths=True).count() == 2


def test_states_of_file_copies(spark, tree, roots):
    catalog = tree([("a/f.txt", "abc", 0), ("b/F.TXT", "abc", 0.9), ("c/f.txt", "abcd", 0), ("d/f.txt", "abc", 1),
                    ("e/other", "abc", 0), ("h/cafe\u0301", "abc", 0), ("i/f.txt", "abc", 3_600)], unreadable=["g"])
    nulls = catalog.files.withColumn("mtime_us", F.when(F.col("folder") != "/data/i", F.col("mtime_us")))
    copies = file_rows(spark, [("1", "f.txt", f"/data/{d}", 36_000, 36_000, 3, "A") for d in "abcdefgi"] +
                       [("1", "f.txt", "/offline/x", 36_000, 36_000, 3, "A"), ("2", "caf\u00e9", "/data/h", 36_000, 36_000, 3, "B")])
    states = copy_states(copies, Catalog(nulls, catalog.folders), roots, "UTC")
    found = {r.folder[-1]: r.state for r in states.collect()}
    assert found == {"a": "Present", "b": "Present", "c": "Changed", "d": "Changed", "e": "Missing", "f": "Missing",
                     "g": "Unavailable", "i": "Unavailable", "x": "Unavailable", "h": "Present"}


def test_states_of_folder_copies(spark, tree, roots):
    catalog = tree([("a/P/f", "abc", 0), ("a/P/s/g", "d", 0), ("b/P/f", "abc", 0), ("b/P/s/G", "e", 9), ("c/P/f", "abcd", 0),
                    ("d/P/f", "abc", 0), ("d/P/s/g", "d", 0), ("d/P/s/t.tmp", "xx", 0), ("d/P/cache/x", "1", 0),
                    ("cache/P/f", "abc", 0), ("cache/P/s/g", "d", 0), ("e/P/f", "abc", 0), ("e/P/s/g", "d", 0)],
                   links=["e/P/s/l"])
    copies = spark.createDataFrame(
        [("1", i, f"/data/{d}/P", "P", 2, 1, 4) for i, d in enumerate(["a", "b", "c", "d", "e", "f", "cache"])] +
        [("1", 9, "/offline/P", "P", 2, 1, 4)], report.FOLDER_COPIES_SCHEMA)
    found = {r.folder: r.state for r in folder_copy_states(copies, catalog, roots, ["*.tmp", "cache"]).collect()}
    assert {k.split("/")[-2]: v for k, v in found.items()} == {
        "a": "Present", "b": "Present", "c": "Changed", "d": "Present", "e": "Unavailable", "f": "Missing",
        "cache": "Present", "offline": "Unavailable"}


def test_validating_an_unchanged_catalog_changes_nothing(spark, tree, roots, tmp_path):
    at = f"file:{tmp_path}/r"
    catalog = tree(TREE)
    scan(spark, catalog, at)
    done = validate(spark, at, catalog, roots)
    row = done.summary.first()
    assert (row.copies_removed, row.rows_removed, row.folder_copies_removed, row.changed) == (0, 0, 0, False)
    assert (row.rows_checked, row.rows_remaining, row.folder_rows_checked) == (11, 11, 3)
    assert done.version is None and done.removed.count() == 0


def test_validating_after_removals(spark, tree, roots, tmp_path):
    at = f"file:{tmp_path}/r"
    gone = ["/data/mail/2020/note.eml", "/data/cam/IMG.png", "/data/two/Album/01.ogg"]
    catalog = tree(TREE)
    scan(spark, catalog, at, ScanSettings(["*.bak"], 2))
    later = catalog._replace(files=catalog.files.filter(~F.col("path").isin(gone)))
    assert validate(spark, at, later, roots, dry_run=True).version is None
    done = validate(spark, at, later, roots)
    row = done.summary.first()
    assert (row.copies_removed, row.rows_removed, row.folder_copies_removed, row.folder_rows_removed) == (3, 2, 1, 1)
    back = read_report(spark, at)
    assert done.version == 2 and back.settings == ScanSettings(["*.bak"], 2)
    kept = back.file_copies.filter("file_name = 'note.eml'").orderBy("pos").collect()
    assert [(r.pos, r.folder) for r in kept] == [(1, "/data/old"), (2, "/data/mail/2021")]
    # A recorded name found in another spelling is logged as it was recorded.
    logged = {(r.path, r.state, r.removed) for r in done.removed.collect()}
    assert ("/data/two/Album", "Changed", True) in logged and ("/data/cam/img.PNG", "Missing", True) in logged


def jobs_of(spark, run):
    """What ``run`` gives, and the number of Spark jobs it started."""
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None), default=-1)
    done = run()
    return done, max(tracker.getJobIdsForGroup(None), default=-1) - before


def test_the_summary_is_counted_on_the_way(spark, roots):
    sets = spark.createDataFrame([(k,) for k in "abcd"], "set_id string")
    states = spark.createDataFrame(
        [("a", "Present"), ("a", "Present"), ("a", "Missing"), ("b", "Present"), ("b", "Changed"), ("c", "Unavailable"), ("c", "Present")],
        "set_id string, state string",
    )
    counted = materialize(row_outcomes(sets, states), "counted", counters=outcome_counters())
    nothing = materialize(row_outcomes(sets.limit(0), states), "nothing", counters=outcome_counters())
    row, jobs = jobs_of(spark, lambda: validation_summary(spark, counted, nothing).first())
    assert jobs <= 1 and row.asDict() == {
        "rows_checked": 4, "copies_checked": 7, "copies_removed": 2, "copies_unavailable": 1, "rows_removed": 2, "rows_remaining": 2,
        **{f"folder_{c}": 0 for c in ("rows_checked", "copies_checked", "copies_removed", "copies_unavailable", "rows_removed", "rows_remaining")},
        "changed": True,
    }
    assert not validation_summary(spark, nothing).first().changed


def test_validation_takes_few_jobs(spark, tree, roots, tmp_path):
    catalog = tree(TREE)
    at = str(tmp_path / "report")
    scan(spark, catalog, at)
    smaller = Catalog(catalog.files.filter("name <> 'a.txt'"), catalog.folders)
    done, jobs = jobs_of(spark, lambda: validate(spark, at, smaller, roots))
    assert done.summary.count() == 1 and jobs <= 60


def test_a_row_without_an_offset_is_compared_by_local_time_and_gets_one(spark, tree, roots, tmp_path):
    at = f"file:{tmp_path}/r"
    catalog = tree([("a/f", "abc", 0), ("b/f", "abc", 0), ("c/f", "abc", 60)])
    local = 10 * 3_600  # Brisbane, no summer time
    copies = file_rows(spark, [("1", "f", f"/data/{d}", local, None, 3, "A" * 32) for d in "abc"] +
                       [("2", "g", "/offline/g", 0, 0, 3, "B" * 32)])
    write_report(spark, at, sets_of(copies), copies)
    done = validate(spark, at, catalog, roots, tz="Australia/Brisbane")
    row = done.summary.first()
    assert (row.copies_removed, row.copies_unavailable, row.rows_removed, row.rows_remaining) == (1, 1, 1, 1)
    assert [(r.copies, r.utc_offset_s) for r in read_report(spark, at).file_sets.collect()] == [(2, 36_000)]


def test_unavailable_copies_never_cause_a_rewrite(spark, tree, roots, tmp_path):
    at = f"file:{tmp_path}/r"
    copies = file_rows(spark, [("1", "f", "/offline/a", 0, 0, 3, "A" * 32), ("1", "f", "/offline/b", 0, 0, 3, "A" * 32)])
    write_report(spark, at, sets_of(copies), copies)
    done = validate(spark, at, tree([("x", "", 0)]), roots)
    assert done.version is None and done.summary.first().copies_unavailable == 2
    assert [r.removed for r in done.removed.collect()] == [False, False]


def test_folders_in_another_case_count_on_windows_only(spark, tree, roots):
    catalog = tree([("A/f.txt", "abc", 0)])
    copies = file_rows(spark, [("1", "f.txt", "/data/a", 0, 0, 3, "A")])
    state = lambda windows: copy_states(copies, catalog, roots, "UTC", windows).first().state
    assert (state(False), state(True)) == ("Missing", "Present")
    folders = spark.createDataFrame([("1", 1, "/data/a", "a", 1, 0, 3)], report.FOLDER_COPIES_SCHEMA)
    state = lambda windows: folder_copy_states(folders, catalog, roots, (), windows).first().state
    assert (state(False), state(True)) == ("Missing", "Present")


def test_what_a_failed_write_left_is_never_published(spark, tree, tmp_path):
    at = f"file:{tmp_path}/r"
    catalog = tree([("a/T/f", "abc", 0), ("b/T/f", "abc", 0)])
    scan(spark, catalog, at)
    # A write of version 2 that got as far as its folder tables, in the layout of today and of before.
    for leftover in ("v=2/old", "v=2"):
        spark.createDataFrame([], report.FOLDER_SETS_SCHEMA).write.parquet(f"{at}/{leftover}/folder_sets")
    done = scan(spark, catalog, at, include_folders=False)
    assert done.version == 2 and read_report(spark, at).folder_sets is None
    assert read_report(spark, at, 1).folder_sets.count() == 1
    with pytest.raises(FileNotFoundError):
        read_report(spark, at, 3)


def test_a_crash_before_publishing_leaves_no_version(spark, tmp_path, monkeypatch):
    at = f"file:{tmp_path}/r"
    copies = file_rows(spark, [("1", "f", "/x/a", 0, 0, 3, "A" * 32), ("1", "f", "/x/b", 0, 0, 3, "A" * 32)])
    assert write_report(spark, at, sets_of(copies), copies) == 1

    def crash(*args):
        raise KeyboardInterrupt

    for step in ("claim", "publish"):
        with monkeypatch.context() as broken:
            broken.setattr(report, step, crash)
            with pytest.raises(KeyboardInterrupt):
                write_report(spark, at, sets_of(copies), copies)
        assert report.versions(spark, at) == [1] and read_report(spark, at).file_copies.count() == 2
    # The second crash has claimed number 2, which is never used.
    assert write_report(spark, at, sets_of(copies), copies) == 3 and report.versions(spark, at) == [1, 3]


def test_an_empty_marker_is_no_version(spark, tmp_path):
    at = f"file:{tmp_path}/r"
    copies = file_rows(spark, [("1", "f", "/x/a", 0, 0, 3, "A" * 32), ("1", "f", "/x/b", 0, 0, 3, "A" * 32)])
    write_report(spark, at, sets_of(copies), copies)
    (tmp_path / "r/v=2").mkdir()
    (tmp_path / "r/v=2/_PUBLISHED").touch()
    assert report.versions(spark, at) == [1]
    assert write_report(spark, at, sets_of(copies), copies) == 3 and read_report(spark, at).file_sets.count() == 1


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    at = f"file:{tmp_path}/r"
    copies = file_rows(spark, [("1", "f", "/x/a", 0, 0, 3, "A" * 32), ("1", "f", "/x/b", 0, 0, 3, "A" * 32)])
    plain, others = report.write_settings, []

    def meanwhile(*args):
        plain(*args)
        if not others:
            others.append(None)
            others.append(write_report(spark, at, sets_of(copies), copies))

    monkeypatch.setattr(report, "write_settings", meanwhile)
    with pytest.raises(publishing.Conflict):
        write_report(spark, at, sets_of(copies), copies)
    assert others == [None, 1] and report.versions(spark, at) == [1]
    # And one that has the same number in hand, but not yet published.
    publishing.claim(spark, f"{at}/first")
    with pytest.raises(publishing.Conflict):
        publishing.claim(spark, f"{at}/first")
    publishing.publish(spark, f"{at}/second", {"a": 1})
    with pytest.raises(publishing.Conflict):
        publishing.publish(spark, f"{at}/second", {"a": 2})
    assert publishing.read_published(spark, f"{at}/second") == {"a": 1}


def test_old_versions_go_on_request(spark, tmp_path):
    at = f"file:{tmp_path}/r"
    copies = file_rows(spark, [("1", "f", "/x/a", 0, 0, 3, "A" * 32), ("1", "f", "/x/b", 0, 0, 3, "A" * 32)])
    assert [write_report(spark, at, sets_of(copies), copies) for _ in range(4)] == [1, 2, 3, 4]
    assert report.prune(spark, at, 2) == [1, 2] and report.versions(spark, at) == [3, 4]
    assert report.prune(spark, at, 2) == [] and read_report(spark, at).file_copies.count() == 2


def test_two_spellings_of_one_folder_give_one_row(spark, tree, roots):
    catalog = tree([("A/f.txt", "abc", 0), ("a/f.txt", "abcd", 0)])
    folders = spark.createDataFrame([("1", 1, "/data/a", "a", 1, 0, 4), ("1", 2, "/data/A", "A", 1, 0, 3)], report.FOLDER_COPIES_SCHEMA)
    found = folder_copy_states(folders, catalog, roots, (), True).collect()
    assert sorted((r.folder, r.state) for r in found) == [("/data/A", "Present"), ("/data/a", "Present")]


def test_a_scan_that_could_read_nothing_publishes_nothing(spark, tree, tmp_path):
    at = f"file:{tmp_path}/r"
    scan(spark, tree([("a/f", "abc", 0), ("b/f", "abc", 0)]), at)
    listed = tree([("a/f", "abc", 0), ("b/f", "abc", 0)])
    lost = listed._replace(files=listed.files.withColumn("content", F.lit(None).cast("string")))
    with pytest.raises(OSError):
        scan(spark, lost, at, rehash=True)
    with pytest.raises(Exception, match="cannot be read here"):
        there = F.concat(F.lit("nowhere://bucket"), F.col("path"))
        scan(spark, listed._replace(files=listed.files.drop("content").withColumn("path", there)), at, rehash=True)
    assert report.versions(spark, at) == [1]


def test_what_a_scan_skips_is_said(spark, tree):
    listed = tree([("a/f", "abc", 0), ("b/f", "abc", 0), ("c/f", "abc", 0)], unreadable=["d"])
    lost = F.when(F.col("path") != "/data/c/f", F.col("content"))
    done = scan(spark, listed._replace(files=listed.files.withColumn("content", lost)), include_folders=False)
    assert sorted((r.kind, r.path) for r in done.skipped.collect()) == [("folder", "/data/d"), ("hash", "/data/c/f")]


def test_large_objects_told_apart_by_their_first_bytes_are_no_failure(spark, tmp_path):
    at, size = f"file:{tmp_path}/r", 16 << 20
    for folder, start in (("a", b"1"), ("b", b"2")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "f").write_bytes(start * size)
    root = f"{tmp_path}/in"
    rows = [(f"{root}/{d}/f", "f", f"{root}/{d}", size, 0, 0) for d in ("a", "b", "gone")]
    files = spark.createDataFrame(rows, "path string, name string, folder string, size_bytes bigint, mtime_us bigint, attributes int")
    folders = spark.createDataFrame([(f"{root}/{d}", True, None) for d in ("a", "b", "gone")], "path string, readable boolean, reason string")
    done = scan(spark, Catalog(files, folders), at)
    assert done.version == 1 and done.files.sets.count() == 0
    # Only what could not be read is said to be so.
    assert [(r.kind, r.path) for r in done.skipped.collect()] == [("hash", f"{root}/gone/f")]
    with pytest.raises(OSError):
        lost = files.withColumn("path", F.concat("path", F.lit(".lost")))
        scan(spark, Catalog(lost, folders), at, rehash=True)
