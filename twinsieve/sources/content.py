"""Content hashing: from a content column where there is one, else by reading the objects."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from functools import reduce
from typing import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import md5_hex
from ..session import Table, materialize, partitions_for, small

CHUNK_BYTES = 1 << 20
OBJECTS_PER_TASK = 10_000

BYTES_PER_TASK = 8 << 30

# The filter of wanted paths: bits of a block, bits and hashes for each path, and bytes in all.
BLOCK_BITS = 2_048
FILTER_BITS = 16
FILTER_HASHES = 4
FILTER_BYTES = 64 << 20

NO_FILE = "not a regular file"
OBJECTS_SCHEMA = "path string, md5 string, reason string"
_PLACE = re.compile("^([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)(.*)$")


class UnsupportedLocation(ValueError):
    """No file system can read paths of this kind; the job fails instead of leaving files out."""


@functools.lru_cache(maxsize=64)
def _file_system(place: str) -> fs.FileSystem:
    """The file system of ``scheme://authority``, or of local paths (the empty place), once per worker."""
    if not place:
        return fs.LocalFileSystem()
    try:
        return fs.FileSystem.from_uri(f"{place}/")[0]
    except (pa.ArrowException, OSError, ImportError) as problem:
        raise UnsupportedLocation(f"Objects at {place} cannot be read here: {problem}") from problem


def is_uri(path: str) -> bool:
    return _PLACE.match(path) is not None


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system, and the path inside it."""
    match = _PLACE.match(path)
    if match is None:
        return _file_system(""), path
    scheme, authority, inner = match.groups()
    system = _file_system(f"{scheme}://{authority}")
    return system, inner if scheme in ("file", "hdfs", "viewfs") else f"{authority}{inner}"


def local_path(path: str) -> str | None:
    """The path on a mount that a path or a ``file`` URI names; None for other URIs."""
    match = _PLACE.match(path)
    if match is None:
        return path
    return match.group(3) if match.group(1) == "file" and not match.group(2) else None


def object_digest(path: str, limit: int) -> tuple[str | None, str | None]:
    """(MD5, None) of an object or of its first ``limit`` bytes, or (None, why it cannot be read).

    Pipes and devices are never opened: that could wait for ever.
    """
    system, inner = located(path)
    mounted = local_path(path)
    if mounted is not None and os.path.exists(mounted) and not os.path.isfile(mounted):
        return None, NO_FILE
    digest, left = hashlib.md5(usedforsecurity=False), limit
    try:
        with system.open_input_stream(inner) as stream:
            while block := stream.read(min(CHUNK_BYTES, left) if limit else CHUNK_BYTES):
                digest.update(block)
                left -= len(block)
    except (OSError, pa.ArrowException) as problem:
        return None, str(problem)
    return digest.hexdigest().upper(), None


def read_objects(wanted: Table, limit: int = 0) -> DataFrame:
    """(path, md5, reason) of objects read where the executors can reach them: local mounts and any file system
    known by URI (``file``, ``hdfs``, ``s3``, ``gs``, ``abfs``). Memory per task is one chunk.

    A path of another kind is an error. Objects are spread by number, and by bytes where sizes are known.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [object_digest(p, limit) for p in paths]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                names=["path", "md5", "reason"],
            )

    tasks = partitions_for(wanted.df.sparkSession, wanted.rows, OBJECTS_PER_TASK)
    if "size_bytes" in wanted.df.columns:
        size = F.least("size_bytes", F.lit(limit)) if limit else F.col("size_bytes")
        total = wanted.df.agg(F.sum(size)).first()[0] or 0
        tasks = max(tasks, min(max(1, wanted.rows), -(-total // BYTES_PER_TASK)))
    return wanted.df.select("path").repartition(tasks).mapInArrow(work, OBJECTS_SCHEMA)


def hash_objects(wanted: Table, limit: int = 0) -> DataFrame:
    """(path, md5) of the objects that can be read."""
    return read_objects(wanted, limit).filter("md5 is not null").select("path", "md5")


def content_hashes(files: DataFrame, wanted: Table, limit: int = 0) -> DataFrame:
    """(path, md5) of the wanted paths; with ``limit``, of their first bytes only.

    Content is never shuffled. A wanted list of checked size is broadcast, so only wanted rows are
    hashed. Beyond that a filter of bounded size, made of the wanted paths, is broadcast in its place: what passes is hashed where
    it is scanned, and only (path, md5) is joined. A file whose content cannot be read has no row.
    """
    if "content" not in files.columns:
        return hash_objects(wanted, limit)
    paths = wanted.df.select("path")
    # Tested on the content: a test of the hash would be pushed below the join and hash every row.
    readable = files.select("path", "content").filter("content is not null")
    md5 = md5_hex("content", limit).alias("md5")
    if small(wanted):
        return readable.join(F.broadcast(paths), "path", "left_semi").select("path", md5)
    hashed = likely_wanted(readable, wanted).select("path", md5)
    # An inner join: a semi join would be pushed below the hashes, and contents shuffled.
    return hashed.join(paths.distinct(), "path")


def path_filter(wanted: Table) -> tuple[DataFrame, int]:
    """A Bloom filter of the wanted paths in blocks, (block, bits), and the number of blocks.

    A path sets FILTER_HASHES bits of one block. There are FILTER_BITS bits for each path, up to FILTER_BYTES in all; with
    more paths than that allows the filter lets more of the others pass, never fewer of the wanted ones.
    """
    blocks = max(1, min(-(-wanted.rows * FILTER_BITS // BLOCK_BITS), FILTER_BYTES * 8 // BLOCK_BITS))
    bits = wanted.df.select(_block(blocks).alias("block"), F.explode(F.array(*_bits())).alias("bit"))
    words = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("set"))
    # At most a word for each 64 bits of a block.
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("words"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("bigint")))
    return held.select("block", dense.alias("bits")), blocks


def likely_wanted(files: DataFrame, wanted: Table) -> DataFrame:
    """The rows of ``files`` whose path passes the wanted paths' filter, all wanted ones among them; nothing is shuffled."""
    bits, blocks = path_filter(wanted)
    table = materialize(bits, "path-filter", columnar=True).df.withColumnRenamed("block", "filter_block")
    joined = files.join(F.broadcast(table), _block(blocks) == F.col("filter_block"))
    is_set = [F.get("bits", F.shiftright(bit, 6)).bitwiseAND(_mask(bit)) != 0 for bit in _bits()]
    return joined.filter(reduce(Column.__and__, is_set)).select(*files.columns)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(blocks))


def _bits() -> list[Column]:
    """The places of a path's bits in its block."""
    width = BLOCK_BITS.bit_length() - 1
    own = F.xxhash64(F.lit("bits"), "path")
    return [F.shiftrightunsigned(own, width * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(FILTER_HASHES)]


def _mask(bit: Column) -> Column:
    powers = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)])
    return F.get(powers, bit.bitwiseAND(F.lit(63)))
