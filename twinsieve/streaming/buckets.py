"""The inventory of a stream, bucketed by name key, and its folders' sums, bucketed by path: a base and deltas for each bucket.

A file's bucket follows from its name, so a drop touches the buckets of its names alone. Each batch writes a delta for those
and a small file that lists every bucket's folders; a bucket with many deltas is written anew.
"""

from __future__ import annotations

from typing import Collection, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tree_sums import TREE_SCHEMA
from ..sources.publishing import children, delete, exists, is_published, publish, read_published
from ..sources.report import BUCKET, read_buckets, write_buckets, written_buckets

BUCKETS = 64
DELTAS = 8  # of a bucket, before it is written anew

INVENTORY_SCHEMA = (
    "path string, folder string, name string, size_bytes bigint, mtime_us bigint, attributes int, "
    "name_key string, saved_s bigint, md5 string"
)
_COMPLETE = "_COMPLETE"


class Kind(NamedTuple):
    """What a state has rows of: their columns, ``path`` among them, and the column that names a row's bucket."""

    columns: str
    key: str

    @property
    def rows_schema(self) -> str:
        return f"{self.columns}, deleted boolean, seq bigint"


FILES, FOLDERS = Kind(INVENTORY_SCHEMA, "name_key"), Kind(TREE_SCHEMA, "path")


class State(NamedTuple):
    """Where the inventory after a batch is: for each bucket its folders below the state folder and the number of files in each,
    the base first."""

    folder: str
    batch: int
    buckets: int
    parts: dict[int, list[tuple[str, int]]]
    kind: Kind = FILES


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def load_state(spark: SparkSession, folder: str, batch: int, buckets: int = BUCKETS, kind: Kind = FILES) -> State:
    """The state after a batch. Only before the first one there is none; later the number of buckets is the recorded one."""
    if batch < 0:
        return State(folder, batch, buckets, {}, kind)
    path = f"{folder}/batch={batch}/{_COMPLETE}"
    if not is_published(spark, path):
        raise FileNotFoundError(f"The inventory of batch {batch} is missing or incomplete at '{folder}/batch={batch}'.")
    found = read_published(spark, path)
    parts = {int(k): [(at, n) for at, n in parts] for k, parts in found["parts"].items()}
    return State(folder, batch, found["buckets"], parts, kind)


def has_state(spark: SparkSession, folder: str, batch: int) -> bool:
    return is_published(spark, f"{folder}/batch={batch}/{_COMPLETE}")


def inventory(spark: SparkSession, state: State, buckets: Collection[int] | None = None) -> DataFrame:
    """The rows in the given buckets (all by default). A folder or a file of one that is lost is an error."""
    wanted = {k: v for k, v in state.parts.items() if buckets is None or k in buckets}
    folders = [part for parts in wanted.values() for part in parts]
    for at, files in folders:
        here = sum(name.endswith(".parquet") for name in children(spark, f"{state.folder}/{at}"))
        if here != files:
            raise FileNotFoundError(f"A bucket of the inventory is damaged: '{state.folder}/{at}' has {here} of {files} files.")
    rows = read_buckets(spark, state.kind.rows_schema, [f"{state.folder}/{at}" for at, _ in sorted(folders)])
    if any(len(parts) > 1 for parts in wanted.values()):
        # A path has at most a row for each of its bucket's parts.
        newest = F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "seq").alias("row")
        rows = rows.groupBy("path").agg(newest).select("path", "row.*")
    return rows.filter("not deleted").drop("deleted", "seq")


def written_delta(spark: SparkSession, state: State, batch: int, arrived: DataFrame) -> DataFrame:
    """Write the rows of a drop (a row of the state's kind each, with ``deleted``) to their buckets, and read them again."""
    rows = arrived.withColumn("seq", F.lit(batch).cast("bigint")).withColumn(BUCKET, bucket_of(state.kind.key, state.buckets))
    folder = f"{state.folder}/batch={batch}/delta"
    write_buckets(rows, folder)
    return read_delta(spark, state, batch)


def read_delta(spark: SparkSession, state: State, batch: int) -> DataFrame:
    folder = f"{state.folder}/batch={batch}/delta"
    return read_buckets(spark, state.kind.rows_schema, [f"{folder}/{BUCKET}={k}" for k in written_buckets(spark, folder)]).drop("seq")


def advance(spark: SparkSession, state: State, batch: int) -> State:
    """Publish the state that has a batch's delta; buckets with more than DELTAS of them are written anew first."""
    folder = f"batch={batch}"

    def parts_in(kind: str) -> dict[int, tuple[str, int]]:
        at = {int(k): f"{folder}/{kind}/{BUCKET}={k}" for k in written_buckets(spark, f"{state.folder}/{folder}/{kind}")}
        return {k: (p, sum(name.endswith(".parquet") for name in children(spark, f"{state.folder}/{p}"))) for k, p in at.items()}

    parts = {k: list(v) for k, v in state.parts.items()}
    for k, part in parts_in("delta").items():
        parts.setdefault(k, []).append(part)
    now = state._replace(batch=batch, parts=parts)
    long = [k for k, v in parts.items() if len(v) > DELTAS + 1]
    if long:
        rows = inventory(spark, now, long).withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(batch).cast("bigint"))
        write_buckets(rows.withColumn(BUCKET, bucket_of(now.kind.key, now.buckets)), f"{state.folder}/{folder}/base")
        bases = parts_in("base")
        now = now._replace(parts={k: v for k, v in parts.items() if k not in long} | {k: [bases[k]] for k in long if k in bases})
    publish(spark, f"{state.folder}/{folder}/{_COMPLETE}", {"buckets": now.buckets, "parts": {str(k): v for k, v in now.parts.items()}})
    return now


def forget(spark: SparkSession, state: State, batch: int) -> None:
    """Delete what only the state of an old batch has, given a state and the one before it are kept."""
    if batch < 0 or not has_state(spark, state.folder, batch):
        return
    old, kept = load_state(spark, state.folder, batch), [state]
    if has_state(spark, state.folder, state.batch - 1):
        kept.append(load_state(spark, state.folder, state.batch - 1))
    used = {at for s in kept for parts in s.parts.values() for at, _ in parts}
    for at in {at for parts in old.parts.values() for at, _ in parts} - used:
        delete(spark, f"{state.folder}/{at}")
    delete(spark, f"{state.folder}/batch={batch}/{_COMPLETE}")
    if not any(at.startswith(f"batch={batch}/") for at in used) and exists(spark, f"{state.folder}/batch={batch}"):
        delete(spark, f"{state.folder}/batch={batch}")
