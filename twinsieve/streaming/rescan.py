"""Incremental rescan over arriving inventory drops (Structured Streaming)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.names import name_key
from ..functions.paths import ancestors
from ..functions.values import is_cold, md5_hex
from ..operators.filters import exclude, min_size, split_cold, split_unreadable
from ..operators.groups import lookup
from ..operators.hierarchy import folder_members
from ..operators.sets import file_copies, file_sets
from ..operators.tree_sums import TREE_SCHEMA, file_changes, fingerprints_in, update_tree
from ..plans.duplicate_folders import FolderDuplicates, find_duplicate_folders, top_duplicates
from ..session import materialize
from ..sources.inventory import Catalog, folders_of, metadata
from ..sources.report import (
    BUCKET, ScanSettings, Touched, file_tables, folder_tables, published, report_buckets, versions, write_report,
)
from .buckets import (
    BUCKETS, FOLDERS, State, advance, bucket_of, forget, has_state, inventory, load_state, read_delta, written_delta,
)


def start_rescans(
    spark: SparkSession,
    drops_dir: str,
    schema: str,
    state_dir: str,
    report_dir: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    minimum_size: int = 0,
    tz: str | None = None,
    exclude_names: Sequence[str] = (),
    skip_cold: bool = False,
    include_folders: bool = False,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process every inventory drop that has arrived, then stop (trigger ``availableNow``).

    A drop is Parquet in the ``files`` shape with ``content``, naming new and changed files; a row
    without content stands for an unchanged file, whose recorded hash is kept if size and second
    agree. An optional ``deleted`` column takes files out. Names to exclude, cold files and the smallest size are
    applied as in a scan and stored with the report; with ``include_folders`` folder sets are found anew from the recorded
    hashes after each drop. Inventory and report are kept in ``buckets`` (set by the first drop) of name keys.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def apply(drop: DataFrame, batch_id: int) -> None:
        apply_drop(drop, batch_id, state_dir, report_dir, minimum_size, tz, exclude_names, skip_cold, include_folders, buckets)

    writer = reader.parquet(drops_dir).writeStream.foreachBatch(apply)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_drop(
    drop: DataFrame,
    batch_id: int,
    state_dir: str,
    report_dir: str,
    minimum_size: int = 0,
    tz: str | None = None,
    exclude_names: Sequence[str] = (),
    skip_cold: bool = False,
    include_folders: bool = False,
    buckets: int = BUCKETS,
) -> None:
    """Update the inventory with one drop and publish the report as a new version.

    Only the buckets that the drop's names fall into are read and written, in the inventory and in the report, and
    only sets of the touched name keys are computed; the others are carried over from the version that this stream
    published last. Folder sets, if included, are grouped from kept fingerprints, of which the drop's folders and those above them are
    brought up to date; with names to exclude they take the whole inventory. A version is labelled with its stream and batch, so a
    replayed batch that was published already changes nothing, and one that was not starts from the same earlier state.
    A drop without rows publishes a version with the same sets.
    """
    spark = drop.sparkSession
    tz = tz or spark.conf.get("spark.sql.session.timeZone")
    batches = _published_batches(spark, report_dir, state_dir)
    if batch_id in batches:
        return
    state = load_state(spark, state_dir, batch_id - 1, buckets)
    keys = drop.select(bucket_of(name_key("name"), state.buckets).alias(BUCKET)).distinct()
    # At most as many as there are buckets.
    touched_buckets = {row[0] for row in keys.collect()}
    known = inventory(spark, state, touched_buckets)
    if has_state(spark, state_dir, batch_id):
        # The batch got as far as its inventory before.
        arrived, after = read_delta(spark, state, batch_id), load_state(spark, state_dir, batch_id)
    else:
        arrived = written_delta(spark, state, batch_id, _arrived(drop, known))
        after = advance(spark, state, batch_id)

    earlier = max((b for b in batches if b < batch_id), default=None)
    if earlier is None:
        # Without a version of its own to carry sets over from, every name counts as touched.
        touched_buckets = set(range(after.buckets))
        now = names = inventory(spark, after)
    else:
        now = known.join(arrived.select("path"), "path", "left_anti").unionByName(arrived.filter("not deleted").drop("deleted"))
        names = arrived
    catalog = exclude(Catalog(now, folders_of(now)), exclude_names)
    touched = materialize(names.select("name_key").distinct(), "touched").df
    usable = split_unreadable(min_size(catalog.files.filter("md5 is not null"), minimum_size)).kept
    if skip_cold:
        usable = split_cold(usable).kept
    members = materialize(lookup(usable, touched, ["name_key"], ["path"]), "members", columnar=True)
    sets, copies = file_tables(file_sets(members.df, tz), file_copies(members))
    if earlier is not None:
        sets, copies = (
            new.unionByName(_carried_over(report_buckets(spark, report_dir, batches[earlier], name, touched_buckets), touched))
            for new, name in ((sets, "file_sets"), (copies, "file_copies"))
        )
    sets, copies = (t.withColumn(BUCKET, bucket_of(name_key("file_name"), after.buckets)) for t in (sets, copies))
    folder_rows = folder_copies = None
    if include_folders and not exclude_names:
        found = _folders_after(spark, known, arrived, after, skip_cold)
        folder_rows, folder_copies = folder_tables(found.sets, found.copies)
    elif include_folders:
        whole = inventory(spark, after)
        everything = exclude(Catalog(whole, folders_of(whole)), exclude_names)
        hashes = everything.files.filter("md5 is not null").select("path", "md5")
        plain = everything.files.drop("md5", "name_key", "saved_s").withColumn("content", F.lit(None).cast("binary"))
        found = find_duplicate_folders(plain, everything.folders, skip_cold, hash_cache=hashes)
        folder_rows, folder_copies = folder_tables(found.sets, found.copies)
    settings = ScanSettings(list(exclude_names), minimum_size)
    label = {"stream": state_dir, "batch": batch_id}
    changed = Touched(touched_buckets, None if earlier is None else batches[earlier])
    write_report(spark, report_dir, sets, copies, folder_rows, folder_copies, settings, label, changed)
    forget(spark, after, batch_id - 2)


def _folders_after(spark: SparkSession, known: DataFrame, arrived: DataFrame, after: State, skip_cold: bool) -> FolderDuplicates:
    """Folder sets after a batch. Without the batch before's sums all files count as new."""
    # Cold files have no hash when they are left out, so the two have different sums.
    folder, batch = f"{after.folder}/{'local-' if skip_cold else ''}folders", after.batch
    if not has_state(spark, folder, batch):

        def lines(files: DataFrame, sign: int) -> DataFrame:
            kept = F.when(~is_cold("attributes"), F.col("md5")) if skip_cold else F.col("md5")
            return file_changes(files.withColumn("md5", kept), sign, with_md5=True)

        if batch > 0 and has_state(spark, folder, batch - 1):
            earlier = load_state(spark, folder, batch - 1, kind=FOLDERS)
            gone = known.join(arrived.select("path"), "path", "left_semi")
            changes = lines(gone, -1).unionByName(lines(arrived.filter("not deleted"), 1))
            paths = gone.select("folder").unionByName(arrived.select("folder")).distinct()
            above = paths.select(F.explode(ancestors("folder")).alias("path"))
            touched = {row[0] for row in above.select(bucket_of("path", earlier.buckets)).distinct().collect()}
            before = inventory(spark, earlier, touched)
        else:
            earlier, before = State(folder, batch - 1, after.buckets, {}, FOLDERS), None
            changes = lines(inventory(spark, after), 1)
        update = update_tree(before, changes, implied=True)
        rows = spark.createDataFrame([], TREE_SCHEMA) if update is None else update.touched.df
        written_delta(spark, earlier, batch, rows.withColumn("deleted", (F.col("own") == 0) & (F.col("lines") == 0)))
        forget(spark, advance(spark, earlier, batch), batch - 2)
    now = inventory(spark, load_state(spark, folder, batch, kind=FOLDERS))
    return top_duplicates(materialize(folder_members(fingerprints_in(now)), "folder-members"))


def _published_batches(spark: SparkSession, report_dir: str, state_dir: str) -> dict[int, int]:
    """Version of each batch that this stream has published in buckets."""
    markers = {v: published(spark, report_dir, v) for v in versions(spark, report_dir)}
    own = {v: m["label"] for v, m in markers.items() if m.get("parts") and (m["label"] or {}).get("stream") == state_dir}
    return {label["batch"]: v for v, label in own.items()}


def _arrived(drop: DataFrame, known: DataFrame) -> DataFrame:
    """One row per path of a drop, the one saved last, with its hash; content ends in its scan."""
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in drop.columns else F.lit(False)
    hashed = metadata(drop, md5=md5_hex("content"), deleted=gone)
    row = F.struct(*[c for c in hashed.columns if c != "path"])
    latest = hashed.groupBy("path").agg(F.max_by(row, F.struct("mtime_us", "md5")).alias("row")).select("path", "row.*")
    recorded = known.select(
        "path", F.col("size_bytes").alias("known_size"), F.col("saved_s").alias("known_s"), F.col("md5").alias("known_md5")
    )
    unchanged = (F.col("size_bytes") == F.col("known_size")) & (F.col("saved_s") == F.col("known_s"))
    md5 = F.coalesce("md5", F.when(unchanged, F.col("known_md5")))
    return latest.join(recorded, "path", "left").withColumn("md5", md5).drop("known_size", "known_s", "known_md5")


def _carried_over(table: DataFrame, touched: DataFrame) -> DataFrame:
    keyed = table.withColumn("name_key", name_key("file_name"))
    return lookup(keyed, touched, ["name_key"], table.columns, "left_anti").drop("name_key")
