"""Reading the tables, Arrow batches and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.publishing import delete


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more) with null texts as empty ones; other columns, whatever their names, go."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more
    )


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    return materialize(df, label, columnar=True).df


def forgotten(table: DataFrame) -> None:
    """Delete a table of ``kept`` that nothing will read again; what was made of it is written out by then."""
    files = table.inputFiles()
    if files:
        delete(table.sparkSession, files[0].rsplit("/", 1)[0])


# Rows that a function of by_batch sees at once; bounds what it holds in memory.
ROWS = 256


def by_batch(df: DataFrame, make: Callable[..., dict[str, Any]], schema: str, *args: Any) -> DataFrame:
    """Apply ``make(columns, *args)`` to slices of Arrow batches; it gets and gives columns by name."""
    fields = [part.split()[0] for part in schema.split(", ")]
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = make({n: part.column(k) for k, n in enumerate(part.schema.names)}, *args)
                yield pa.RecordBatch.from_arrays([_array(out[n], arrow.field(n).type) for n in fields], schema=arrow)

    return df.mapInArrow(run, kinds)


def _array(values: Any, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def filter_batches(df: DataFrame, keep: Callable[..., list[bool]], *args: Any) -> DataFrame:
    """The rows for which ``keep(columns, *args)`` says so, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.filter(pa.array(keep({n: part.column(k) for k, n in enumerate(part.schema.names)}, *args), pa.bool_()))

    return df.mapInArrow(run, df.schema)
