"""Fingerprints brought up to date by changes equal those of a full pass."""

import random

import pytest
from pyspark.sql import functions as F

from twinsieve.functions.paths import ancestors
from twinsieve.operators.hierarchy import fingerprint, folder_base
from twinsieve.operators.tree_sums import (
    changed_rows, file_changes, fingerprints_in, folder_changes, next_state, update_tree,
)
from twinsieve.session import materialize
from twinsieve.sources.inventory import folders_of

FILES = "path string, folder string, name string, size_bytes bigint, mtime_us bigint, name_key string, saved_s bigint, md5 string"


def files_frame(spark, files):
    """``files`` maps a path to (size, second, md5); a null size is an unreadable file."""
    rows = []
    for path, (size, second, md5) in files.items():
        folder, name = path.rsplit("/", 1)
        rows.append((path, folder, name, size, second * 1_000_000, name.upper(), second, md5))
    return spark.createDataFrame(rows, FILES)


def folders_frame(spark, folders):
    return spark.createDataFrame(list(folders.items()), "path string, readable boolean")


def shown(rows):
    return sorted(map(tuple, rows.select("path", "fingerprint", "file_count", "folder_count", "size_bytes").collect()))


def full(files, folders):
    return shown(fingerprint(folder_base(files, folders, with_md5=True)).df)


def changes_between(before, after, of):
    gone, new = changed_rows(before, after)
    return of(gone, -1).unionByName(of(new, 1))


def moved(spark, state, files, folders, files2, folders2, **how):
    of_files = lambda rows, sign: file_changes(rows, sign, with_md5=True)
    changes = changes_between(files, files2, of_files).unionByName(changes_between(folders, folders2, folder_changes))
    update = update_tree(state, changes, **how)
    return materialize(next_state(state, update), "state", columnar=True).df, update


def started(files, folders):
    update = update_tree(None, file_changes(files, with_md5=True).unionByName(folder_changes(folders)))
    return materialize(next_state(None, update), "state", columnar=True).df


def above(path):
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def test_random_edits(spark):
    rng = random.Random(5)
    places = [f"/r{a}" + "".join(f"/{rng.choice('abc')}" for _ in range(rng.randint(0, 4))) for a in (1, 2, 2) for _ in range(12)]
    content = lambda: (rng.choice([3, 4, 4, None]) if rng.random() < 0.1 else rng.randint(0, 5), rng.randint(0, 3), rng.choice(["A", "B", "B", None]))
    files = {f"{rng.choice(places)}/f{rng.randint(0, 3)}": content() for _ in range(50)}
    folders = {p: True for f in files for p in above(f.rsplit("/", 1)[0])}
    now = files_frame(spark, files), folders_frame(spark, folders)
    state = started(*now)
    assert shown(fingerprints_in(state)) == full(*now)
    for per_job in (2, 7):
        for _ in range(12):
            files[f"{rng.choice(places)}/f{rng.randint(0, 3)}"] = content()
            files.pop(rng.choice(sorted(files)))
        # Folders go while something is still below them, come back, turn unreadable; some files lie in none.
        for path in rng.sample(sorted({p for f in places for p in above(f)}), 8):
            folders.pop(path, None) if rng.random() < 0.4 else folders.update({path: rng.random() < 0.7})
        then = files_frame(spark, files), folders_frame(spark, folders)
        state, _ = moved(spark, state, *now, *then, levels_per_job=per_job)
        assert shown(fingerprints_in(state)) == full(*then)
        now = then


def test_implied_folders_come_and_go_with_their_files(spark):
    files = {"/a/b/c/f": (1, 1, "A"), "/a/g": (2, 1, "B"), "/z/f": (1, 1, "A")}
    now = files_frame(spark, files)
    update = update_tree(None, file_changes(now, with_md5=True), implied=True)
    state = next_state(None, update)
    for edit in ({"/a/b/c/f": None}, {"/q/r/f": (1, 1, "A"), "/z/f": None}, {"/a/b/c/f": (1, 1, "A")}):
        files = {k: v for k, v in {**files, **edit}.items() if v}
        then = files_frame(spark, files)
        of_files = lambda rows, sign: file_changes(rows, sign, with_md5=True)
        update = update_tree(state, changes_between(now, then, of_files), implied=True)
        state = materialize(next_state(state, update), "state", columnar=True).df
        assert shown(fingerprints_in(state)) == full(then, folders_of(then))
        now = then


def test_only_folders_above_changes_are_touched(spark):
    files = {f"/r/d{i}/e{j}/f": (1, 1, "A") for i in range(20) for j in range(5)}
    folders = {p: True for f in files for p in above(f.rsplit("/", 1)[0])}
    now = files_frame(spark, files), folders_frame(spark, folders)
    state = started(*now)
    changed = {**files, "/r/d3/e2/f": (9, 1, "B"), "/r/d3/e4/f": (9, 1, "B")}
    then = files_frame(spark, changed), folders_frame(spark, folders)
    after, update = moved(spark, state, *now, *then)
    # Two folders with changes, the one above both, /r, and the row of what lies above all roots.
    assert update.touched.rows == update.scope.rows == 5
    assert shown(fingerprints_in(after)) == full(*then)


@pytest.mark.parametrize("folder", ["C:\\x\\y", "\\\\server\\share\\x", "s3://bucket/x"])
def test_other_kinds_of_paths(spark, folder):
    row = [(f"{folder}-f", folder, "f", 1, 1_000_000, "F", 1, "A")]
    files = spark.createDataFrame(row, FILES)
    folders = spark.createDataFrame([(folder,)], "path string").select(F.explode(ancestors("path")).alias("path"), F.lit(True).alias("readable"))
    state = started(files, folders)
    assert shown(fingerprints_in(state)) == full(files, folders)


def test_nothing_and_no_change(spark):
    none = files_frame(spark, {"/a/f": (1, 1, "A")}).limit(0)
    assert update_tree(None, file_changes(none)) is None
    files = files_frame(spark, {"/a/f": (1, 1, "A")})
    folders = folders_frame(spark, {"/a": True})
    state = started(files, folders)
    after, update = moved(spark, state, files, folders, files, folders)
    assert update is None and shown(fingerprints_in(after)) == shown(fingerprints_in(state))
