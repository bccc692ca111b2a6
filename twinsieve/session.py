"""Session settings, intermediate tables and size checks shared by every job."""

from __future__ import annotations

import functools
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Callable, Mapping, NamedTuple, Sequence, TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured key bytes stay below this.
BROADCAST_BYTES = 64 << 20
# A key with more rows than this is "hot": its rows are spread over SALTS partitions.
HOT_GROUP_ROWS = 1_000_000
SALTS = 64

T = TypeVar("T")

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app_name: str = "twinsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for intermediate results: the cluster's checkpoint folder.

    A local session without one gets a temporary folder; a cluster without one is an error,
    since a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"Set {_CHECKPOINT_DIR} to a folder every executor can reach.")
        configured = _local_dir(spark.sparkContext.applicationId)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"twinsieve-{application}-")


class Table(NamedTuple):
    """An intermediate result in the shared folder, with the totals observed while it was written."""

    df: DataFrame
    rows: int
    measured_bytes: int
    most: int | None = None
    least: int | None = None
    seen: Mapping[str, Any] = {}


def materialize(
    df: DataFrame,
    label: str,
    measure: Sequence[str] = (),
    extremes: str | None = None,
    columnar: bool = False,
    folder: str | None = None,
    counters: Sequence[Column] = (),
) -> Table:
    """Compute ``df`` once and cut its lineage in the shared folder, where no executor's loss matters.

    Row count, the byte length of the ``measure`` columns, the extremes of one column and further ``counters``
    (named aggregates, found in ``seen``) are observed on the way, so size checks cost no job. Relations with a row per file are kept
    ``columnar`` (Parquet: compact, readers take only their columns); groups and folders are
    checkpointed, which also keeps their partitioning.
    """
    spark = df.sparkSession
    shared = shared_dir(spark)
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in measure), F.lit(8))
    totals = [F.count(F.lit(1)).alias("rows"), F.sum(width.cast("bigint")).alias("bytes")]
    if extremes is not None:
        totals += [F.max(extremes).alias("most"), F.min(extremes).alias("least")]
    totals += counters
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    observed = df.observe(seen, *totals)
    if columnar or folder:
        path = folder or f"{shared}/twinsieve/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{label}"
        observed.write.mode("overwrite").parquet(path)
        # The schema is known, so reading back needs no inference job.
        kept = spark.read.schema(df.schema).parquet(path)
    else:
        kept = observed.checkpoint()
    found = seen.get
    return Table(kept, found.get("rows") or 0, found.get("bytes") or 0, found.get("most"), found.get("least"), found)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete the written intermediate tables of this application, when none of its results is needed any more.

    Checkpoints go with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/twinsieve/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(table: Table, limit: int | None = None) -> bool:
    """Whether the measured columns of a written table are small enough to broadcast."""
    return table.measured_bytes <= (BROADCAST_BYTES if limit is None else limit)


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for work that Spark cannot size by itself (listing, hashing, ranking)."""
    return max(1, min(spark.sparkContext.defaultParallelism, rows), -(-rows // rows_per_task))


def together(*jobs: Callable[[], T]) -> list[T]:
    """Run independent Spark jobs side by side, so that one's last tasks leave no executor idle."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [done.result() for done in [pool.submit(job) for job in jobs]]
