"""Inventories, file trees, object contents and streams of drops."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinsieve import find_duplicate_files, find_duplicate_folders, load_catalog, read_report, scan_tree
from twinsieve.sources import report, tree
from twinsieve.streaming import buckets, rescan
from twinsieve.streaming.buckets import inventory, load_state
from twinsieve.streaming.rescan import apply_drop, start_rescans

from support import SAVED_US

FILES = "path string, folder string, name string, size_bytes bigint, mtime_us bigint, attributes int, content string"


def put(root, path, content="same", second=0):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(content.encode())
    ns = SAVED_US * 1_000 + int(second * 1e9)
    os.utime(at, ns=(ns, ns))
    return str(at)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_inventories(spark, tmp_path, fmt):
    rows = [("/a/b/x.txt", "1.5KB", "2024-05-17 10:30:00.25"), ("/a/y", "many", "2024-05-17 10:30:00"), ("C:\\d\\z", "7", None)]
    listing = spark.createDataFrame(rows, "path string, size_bytes string, mtime string")
    writer = listing.write.option("header", True) if fmt == "csv" else listing.write
    writer.format(fmt).save(f"{tmp_path}/i")
    catalog = load_catalog(spark, f"{tmp_path}/i", fmt=fmt)
    found = {r.path: (r.folder, r.name, r.size_bytes, r.mtime_us) for r in catalog.files.collect()}
    assert found == {"/a/b/x.txt": ("/a/b", "x.txt", 1_536, SAVED_US + 250_000), "/a/y": ("/a", "y", None, SAVED_US),
                     "C:\\d\\z": ("C:\\d", "z", 7, None)}
    assert sorted(r.path for r in catalog.folders.collect()) == ["/a", "/a/b", "C:\\", "C:\\d"]


def test_listed_folders_with_links(spark, tmp_path):
    spark.createDataFrame([("/a/f",)], "path string").write.parquet(f"{tmp_path}/files")
    spark.createDataFrame([("/a", True, False), ("/a/l", True, True), ("/a/u", False, None)],
                          "path string, readable boolean, is_link boolean").write.parquet(f"{tmp_path}/folders")
    folders = load_catalog(spark, f"{tmp_path}/files", f"{tmp_path}/folders").folders
    assert sorted(map(tuple, folders.collect())) == [("/a", True, None), ("/a/l", False, "link"), ("/a/u", False, "unlistable")]


def test_scan_of_a_tree(spark, tmp_path):
    root = tmp_path / "data"
    for path in ("one/P/a", "one/P/.hidden", "one/P/_u", "two/p/A", "two/p/.hidden", "two/p/_u", "skip/deep/f", "k.tmp"):
        put(root, path, "" if path.endswith("_u") else "c")
    (root / "one/P/none").mkdir(), (root / "two/p/none").mkdir()
    os.symlink(root / "one", root / "loop", target_is_directory=True)
    os.symlink(root / "one", root / "Skip2", target_is_directory=True)
    os.symlink(root / "one/P/a", root / "file-link")
    os.mkfifo(root / "pipe")
    own = put(root, "report.dat")
    catalog, warned = scan_tree(spark, str(root), ["SKIP*", "*.TMP"], spark.createDataFrame([(own,)], "path string"))
    below = lambda rows: sorted(r.path[len(str(root)):] for r in rows)
    assert below(catalog.files.collect()) == sorted([
        "/one/P/a", "/one/P/.hidden", "/one/P/_u", "/two/p/A", "/two/p/.hidden", "/two/p/_u", "/file-link"])
    marks = {(r.path[len(str(root)):], r.readable, r.reason) for r in catalog.folders.collect()}
    assert marks == {("", True, None), ("/one", True, None), ("/one/P", True, None), ("/one/P/none", True, None),
                     ("/two", True, None), ("/two/p", True, None), ("/two/p/none", True, None),
                     ("/loop", False, "link"), ("", False, "excluded file")}
    assert warned.count() == 0
    found = find_duplicate_folders(catalog.files, catalog.folders)
    row = found.sets.first()
    assert (row.folder_name, row.file_count, row.folder_count, row.copies) == ("P", 3, 1, 2)
    with pytest.raises(NotADirectoryError):
        scan_tree(spark, str(root / "k.tmp"))


def test_a_folder_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    from twinsieve.sources import tree as tree_source

    put(tmp_path, "data/a/f")
    rows = list(tree_source._entries(str(tmp_path / "data/none")))
    assert [(r[0], r[1]) for r in rows] == [("error", str(tmp_path / "data/none"))]


def test_objects_are_hashed_in_chunks_and_large_ones_by_their_start(spark, tmp_path, monkeypatch):
    from twinsieve.sources import content

    root = tmp_path / "data"
    body = "x" * 3_000
    for d, n, c in [("a", "same", body), ("b", "same", body), ("a", "start", "1" + body), ("b", "start", "2" + body),
                    ("a", "end", body + "1"), ("b", "end", body + "2"), ("a", "gone", "g"), ("b", "gone", "g"),
                    ("a", "small", "s"), ("b", "small", "s")]:
        put(root, f"{d}/{n}", c)
    catalog, _ = scan_tree(spark, str(root))
    os.remove(root / "b/gone")
    reads = []
    plain = content.hash_objects
    monkeypatch.setattr(content, "hash_objects", lambda wanted, limit=0: reads.append(
        (limit, sorted({r.path.split("/")[-1] for r in wanted.df.collect()}))) or plain(wanted, limit))
    found = find_duplicate_files(catalog.files, first_bytes=1_000, first_bytes_min=2_000)
    assert sorted(r.file_name for r in found.sets.collect()) == ["same", "small"]
    assert reads == [(1_000, ["end", "same", "start"]), (0, ["end", "gone", "same", "small"])]


def rows(spark, *files):
    made = [(f"/d/{p}", "/d/" + p.rsplit("/", 1)[0], p.rsplit("/", 1)[1], n, SAVED_US + s * 10**6, 0, c) for p, c, s, n in files]
    return spark.createDataFrame(made, FILES)


def published(spark, at):
    return sorted((r.file_name, r.copies) for r in read_report(spark, at).file_sets.collect())


def test_drops_update_the_report(spark, tmp_path):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    first = rows(spark, ("a/f", "1", 0, 1), ("b/f", "1", 0, 1), ("a/g", "2", 0, 1), ("b/g", "2", 0, 1))
    apply_drop(first, 0, state, at)
    assert published(spark, at) == [("f", 2), ("g", 2)]
    # A new copy, an edited one, and one without content that has not changed.
    second = rows(spark, ("c/f", "1", 0, 1), ("b/g", "3", 9, 1), ("a/f", None, 0, 1))
    apply_drop(second, 1, state, at)
    assert published(spark, at) == [("f", 3)]
    apply_drop(second, 1, state, at)
    assert published(spark, at) == [("f", 3)], "a replayed batch changes nothing"
    gone = rows(spark, ("c/f", None, 0, 1), ("a/f", None, 0, 1)).withColumn("deleted", F.lit(True))
    apply_drop(gone, 2, state, at)
    assert published(spark, at) == []


def test_stream_of_drops(spark, tmp_path):
    drops, state, at, mark = (f"file:{tmp_path}/{n}" for n in ("drops", "state", "report", "mark"))
    for batch in (rows(spark, ("a/f", "1", 0, 1)), rows(spark, ("b/f", "1", 0, 1)), rows(spark, ("b/f", "2", 5, 1))):
        batch.coalesce(1).write.mode("append").parquet(drops)
        start_rescans(spark, drops, FILES, state, at, mark, tz="UTC").awaitTermination()
        last = published(spark, at)
    assert last == []
    assert len(read_report(spark, at, 2).file_sets.collect()) == 1


def buckets_of(tmp_path, batch):
    return {int(k): [at for at, _ in parts] for k, parts in json.loads((tmp_path / f"state/batch={batch}/_COMPLETE").read_text())["parts"].items()}


def report_parts(spark, at, version):
    return report.published(spark, at, version)["parts"]


def test_a_drop_touches_the_buckets_of_its_names_alone(spark, tmp_path, monkeypatch):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    everything = {}

    def drop(batch, *files, deleted=()):
        for p, c, s, n in files:
            everything[p] = (c, s, n)
        gone = rows(spark, *[(p, None, 0, 1) for p in deleted]).withColumn("deleted", F.lit(True))
        for p in deleted:
            everything.pop(p)
        apply_drop(rows(spark, *files).withColumn("deleted", F.lit(False)).unionByName(gone), batch, state, at, tz="UTC", buckets=16)
        groups = Counter((p.rsplit("/", 1)[1], *v) for p, v in everything.items())
        assert published(spark, at) == sorted((name, n) for (name, *_), n in groups.items() if n > 1)
        stored = inventory(spark, load_state(spark, state, batch))
        assert sorted(r.path for r in stored.collect()) == sorted(f"/d/{p}" for p in everything)

    drop(0, *[(f"{d}/f{i}", str(i % 3), 0, 1) for d in "abc" for i in range(40)])
    before, first = buckets_of(tmp_path, 0), report_parts(spark, at, 1)
    assert len(before) > 10 and set(map(int, first["file_sets"])) == set(before)
    drop(1, ("d/f1", "1", 0, 1), ("a/f2", "changed", 7, 1), deleted=["b/f3"])
    after, second = buckets_of(tmp_path, 1), report_parts(spark, at, 2)
    touched = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(touched) <= 3 and all(len(after[k]) == 2 for k in touched)
    for table in ("file_sets", "file_copies"):
        assert {int(k) for k in second[table] if second[table][k] != first[table].get(k)} == touched
    # Deltas are merged after a while, and what no state has any more goes; so do old versions, but for the buckets still in use.
    monkeypatch.setattr(buckets, "DELTAS", 2)
    for batch in range(2, 6):
        drop(batch, (f"e{batch}/f1", "1", 0, 1), ("d/f1", str(batch), batch, 1))
    last = buckets_of(tmp_path, 5)
    assert max(map(len, last.values())) <= 3 and any("/base/" in at for parts in last.values() for at in parts)
    assert not (tmp_path / "state/batch=2/_COMPLETE").exists()
    want = published(spark, at)
    assert report.prune(spark, at, 1) == [1, 2, 3, 4, 5] and report.versions(spark, at) == [6]
    assert published(spark, at) == want and (tmp_path / "report/v=1").exists() and not (tmp_path / "report/v=4").exists()
    drop(6, deleted=[p for p in everything if p.endswith("/f5")])


def test_a_lost_bucket_is_an_error(spark, tmp_path):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    apply_drop(rows(spark, ("a/f", "1", 0, 1), ("b/f", "1", 0, 1)), 0, state, at)
    (folder,), = buckets_of(tmp_path, 0).values()
    for part in (tmp_path / "state" / folder).glob("*.parquet"):
        part.unlink()
    with pytest.raises(FileNotFoundError, match="damaged"):
        apply_drop(rows(spark, ("c/f", "1", 0, 1)), 1, state, at)
    assert published(spark, at) == [("f", 2)]


def test_a_batch_that_lost_its_report_is_finished(spark, tmp_path, monkeypatch):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    apply_drop(rows(spark, ("a/f", "1", 0, 1), ("b/f", "1", 0, 1)), 0, state, at)
    second = rows(spark, ("c/f", "1", 0, 1), ("a/g", "1", 0, 1), ("b/g", "1", 0, 1))

    def crash(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(rescan, "write_report", crash)
        with pytest.raises(KeyboardInterrupt):
            apply_drop(second, 1, state, at)
    apply_drop(second, 1, state, at)
    assert published(spark, at) == [("f", 3), ("g", 2)] and report.versions(spark, at) == [1, 2]


def test_an_empty_drop_keeps_the_sets(spark, tmp_path):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    for batch in (0, 1):
        apply_drop(rows(spark), batch, state, at)
    assert published(spark, at) == []
    apply_drop(rows(spark, ("a/f", "1", 0, 1), ("b/f", "1", 0, 1)), 2, state, at)
    apply_drop(rows(spark), 3, state, at)
    assert published(spark, at) == [("f", 2)]


def test_a_lost_inventory_is_an_error(spark, tmp_path):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    apply_drop(rows(spark, ("a/f", "1", 0, 1), ("b/f", "1", 0, 1)), 0, state, at)
    os.remove(tmp_path / "state/batch=0/_COMPLETE")
    with pytest.raises(FileNotFoundError):
        apply_drop(rows(spark, ("c/f", "1", 0, 1)), 1, state, at)
    assert published(spark, at) == [("f", 2)]


def test_drops_beside_scans_and_with_folders(spark, tmp_path):
    """A stream never writes into a version that a scan has published, and carries over from its own."""
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    first = rows(spark, ("a/T/f", "1", 0, 1), ("b/T/f", "1", 0, 1), ("a/T/g.tmp", "2", 0, 1), ("b/T/g.tmp", "2", 0, 1))
    copies = spark.createDataFrame([], report.FILE_COPIES_SCHEMA)
    report.write_report(spark, at, spark.createDataFrame([], report.FILE_SETS_SCHEMA), copies)
    for batch, drop in enumerate([first, rows(spark, ("c/T/f", "1", 0, 1))]):
        apply_drop(drop, batch, state, at, exclude_names=["*.tmp"], include_folders=True)
    assert report.versions(spark, at) == [1, 2, 3] and read_report(spark, at, 1).file_sets.count() == 0
    last = read_report(spark, at)
    assert published(spark, at) == [("f", 3)] and last.settings.exclude_names == ["*.tmp"]
    assert [(r.folder_name, r.copies) for r in last.folder_sets.collect()] == [("T", 3)]


def test_folders_of_a_stream_are_brought_up_to_date(spark, tmp_path, monkeypatch):
    """After each drop the folder sets are those of a whole scan; only folders above changes are written."""
    from twinsieve.streaming import rescan

    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    trees = [(f"{side}/T{i}/s/f{j}", f"{i}{j}", 0, 1) for side in "ab" for i in range(4) for j in range(2)]
    drops = [
        rows(spark, *trees),
        rows(spark, ("a/T1/s/f0", "x", 0, 1), ("c/T2/s/f0", "20", 0, 1), ("c/T2/s/f1", "21", 0, 1)),
        rows(spark, ("b/T1/s/f0", "x", 0, 1)),
        rows(spark, ("c/T2/s/f1", None, 0, 1), ("a/T3/s/f0", None, 0, 1), ("a/T3/s/f1", None, 0, 1)).withColumn("deleted", F.lit(True)),
    ]
    want = [
        [("T0", 2), ("T1", 2), ("T2", 2), ("T3", 2)], [("T0", 2), ("T2", 3), ("T3", 2)],
        [("T0", 2), ("T1", 2), ("T2", 3), ("T3", 2)], [("T0", 2), ("T1", 2), ("T2", 2)],
    ]
    whole = []
    plain = rescan.update_tree
    monkeypatch.setattr(rescan, "update_tree", lambda before, *a, **k: whole.append(before is None) or plain(before, *a, **k))
    for batch, drop in enumerate(drops):
        apply_drop(drop, batch, state, at, include_folders=True)
        assert sorted((r.folder_name, r.copies) for r in read_report(spark, at).folder_sets.collect()) == want[batch]
    assert whole == [True, False, False, False]
    third = spark.read.parquet(f"{state}/folders/batch=2/delta")
    assert sorted(r.path for r in third.collect()) == ["/", "/d", "/d/b", "/d/b/T1", "/d/b/T1/s"]


def test_cold_files_of_a_stream_leave_their_folders_unproven(spark, tmp_path):
    state, at = f"file:{tmp_path}/state", f"file:{tmp_path}/report"
    drop = rows(spark, ("a/T/f", "1", 0, 1), ("b/T/f", "1", 0, 1), ("a/U/f", "2", 0, 1), ("b/U/f", "2", 0, 1))
    cold = F.when(F.col("path") == "/d/a/U/f", 0x400000).otherwise(0)
    apply_drop(drop.withColumn("attributes", cold), 0, state, at, skip_cold=True, include_folders=True)
    assert [(r.folder_name, r.copies) for r in read_report(spark, at).folder_sets.collect()] == [("T", 2)]


def test_file_uris_are_read(spark, tmp_path):
    from twinsieve.sources.content import object_digest

    put(tmp_path, "a b/ü", "content")
    plain = object_digest(f"{tmp_path}/a b/ü", 0)
    assert plain[0] == object_digest(f"file://{tmp_path}/a b/ü", 0)[0] == "9A0364B9E99BB480DD25E1F0284C8555"
    assert object_digest(f"{tmp_path}/none", 0)[0] is None
    with pytest.raises(ValueError):
        object_digest("nowhere://x/y", 0)


def test_links_loops_and_pipes_are_alike_by_mount_and_by_uri(spark, tmp_path):
    root = tmp_path / "data"
    put(root, "a/f"), put(root, "a/b/g", "longer")
    (root / "a/loop").symlink_to(root / "a")
    (root / "a/up").symlink_to("..")
    (root / "a/b/self").symlink_to("self")
    (root / "a/b/broken").symlink_to("nothing")
    (root / "a/b/to-file").symlink_to(root / "a/f")
    os.mkfifo(root / "a/b/pipe")
    (root / "a/b/to-pipe").symlink_to(root / "a/b/pipe")
    found = {}
    for kind, start in (("mount", str(root)), ("uri", f"file://{root}")):
        catalog, warnings = scan_tree(spark, start)
        cut = len(start)
        found[kind] = (
            sorted((r.path[cut:], r.name, r.size_bytes, r.mtime_us) for r in catalog.files.collect()),
            sorted((r.path[cut:], r.readable, r.reason or "") for r in catalog.folders.collect()),
            sorted((r.kind, r.path[cut:]) for r in warnings.collect()),
        )
        assert all(r.folder.startswith(start) for r in catalog.files.collect())
        copies = find_duplicate_files(catalog.files).copies.df.collect()
        assert sorted(r.path[cut:] for r in copies) == []
    assert found["mount"] == found["uri"]
    files, folders, skipped = found["uri"]
    assert [(p, n) for p, _, n, _ in files] == [("/a/b/g", 6), ("/a/b/to-file", 4), ("/a/f", 4)]
    assert folders == [("", True, ""), ("/a", True, ""), ("/a/b", True, ""), ("/a/loop", False, "link"), ("/a/up", False, "link")]
    assert skipped == [("entry", "/a/b/self")]
    # What holds a link is never taken for fully known.
    catalog, _ = scan_tree(spark, f"file://{root}")
    assert find_duplicate_folders(catalog.files, catalog.folders).sets.count() == 0


def test_pipes_are_never_opened(tmp_path):
    from twinsieve.sources.content import NO_FILE, object_digest

    os.mkfifo(tmp_path / "pipe")
    assert object_digest(f"{tmp_path}/pipe", 0) == object_digest(f"file://{tmp_path}/pipe", 0) == (None, NO_FILE)
    assert object_digest(str(tmp_path), 0)[0] is None


def test_one_large_folder_goes_to_several_tasks(spark, tmp_path, monkeypatch):
    root = tmp_path / "data"
    root.mkdir()
    for i in range(900):
        (root / f"f{i:04}").write_text("x" * (i % 7))
    plain, tasks = tree.materialize, []

    def watched(df, label, *args, **kwargs):
        done = plain(df, label, *args, **kwargs)
        if label == "sizes":
            tasks.append(done.df.select(F.input_file_name()).distinct().count())
        return done

    monkeypatch.setattr(tree, "FILES_PER_TASK", 100)
    monkeypatch.setattr(tree, "materialize", watched)
    catalog, _ = scan_tree(spark, f"file://{root}", exclude_names=["f0001"])
    sizes = {r.name: r.size_bytes for r in catalog.files.collect()}
    assert sizes == {f"f{i:04}": i % 7 for i in range(900) if i != 1} and tasks[0] > 4


def test_names_that_are_no_text_and_trees_by_uri(spark, tmp_path):
    root = tmp_path / "data"
    put(root, "a/f"), put(root, "b/a/f"), put(root, "b/a/g ü")
    with open(os.fsencode(root) + b"/a/bad\xff", "wb") as out:
        out.write(b"x")
    catalog, warnings = scan_tree(spark, str(root))
    assert [(r.kind, r.path, r.reason) for r in warnings.collect()] == [("entry", f"{root}/a/bad\\xff", "name is not UTF-8")]
    assert sorted(r.path for r in catalog.files.collect()) == [f"{root}/a/f", f"{root}/b/a/f", f"{root}/b/a/g ü"]
    assert {r.path for r in catalog.folders.filter("not readable").collect()} == {f"{root}/a"}
    by_uri, _ = scan_tree(spark, f"file://{root}/b")
    assert sorted((r.path, r.size_bytes) for r in by_uri.files.collect()) == [(f"file://{root}/b/a/f", 4), (f"file://{root}/b/a/g ü", 4)]
    with pytest.raises(NotADirectoryError):
        scan_tree(spark, f"file://{root}/none")
