"""Small files that say what belongs together, seen whole or not at all."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published first."""


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, where = file_system(spark, folder)
    return sorted(status.getPath().getName() for status in fs.listStatus(where)) if fs.exists(where) else []


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether a file is there with something in it: an empty one is what a crashed writer has left."""
    fs, where = file_system(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).getLen() > 0


def read_published(spark: SparkSession, path: str) -> dict:
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, value: dict) -> None:
    """Write ``value`` aside in the same folder and rename it, so that no reader meets half of it."""
    folder, name = path.rsplit("/", 1)
    fs, target = file_system(spark, path)
    _, aside = file_system(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise Conflict(f"'{path}' is published already.")


def claim(spark: SparkSession, path: str) -> None:
    """Create an empty file that only one writer can create."""
    fs, where = file_system(spark, path)
    try:
        fs.create(where, False).close()
    except Py4JJavaError as problem:
        if "AlreadyExists" not in problem.java_exception.getClass().getName():
            raise
        raise Conflict(f"'{path}' belongs to another writer.") from problem
