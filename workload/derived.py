"""The catalog that Spark derives from ``documents``: every document under up to three roots.

Counts and rules are in FIXTURES.md §2. The SQL form of the same catalog is in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.paths import ancestors
from twinsieve.sources.inventory import Catalog

# Fixed values of the derived catalog.
EPOCH_US = 1_704_067_200_000_000
ROOTS = ["/live", "/backup", "/archive"]
LARGE_BYTES, FIRST_BYTES = 4_096, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    doc, source = F.col("doc_id"), F.col("source")
    archived = (source == "src1") & (doc < 200)
    noisy = F.regexp_extract(source, r"(\d+)", 1).cast("int") % 2 == 0
    kept_in_backup = ~(noisy & (doc % 19 == 0))
    roots = F.filter(
        F.array(
            F.lit("live"), F.when(kept_in_backup, F.lit("backup")), F.when(archived, F.lit("archive"))
        ),
        lambda root: root.isNotNull(),
    )
    rows = docs.withColumn("noisy", noisy).withColumn("root", F.explode(roots))
    backup = F.col("root") == "backup"
    changed = backup & F.col("noisy")
    block = F.concat(F.lit("b"), F.floor(doc / 200).cast("string"))
    folder = F.when(
        F.col("root") == "archive", F.concat_ws("/", F.lit("/archive"), F.col("lang"), block)
    ).otherwise(F.concat_ws("/", F.concat(F.lit("/"), F.col("root")), F.col("lang"), source, block))
    name = F.concat(F.lit("d"), (doc % 200).cast("string"), F.lit(".txt"))
    name = F.when(backup & (doc % 3 == 0), F.upper(name)).otherwise(name)
    mtime = (
        F.lit(EPOCH_US)
        + (doc % 60) * 1_000_000
        + F.when(backup, 400_000).otherwise(0)
        + F.when(changed & (doc % 17 == 0), 60_000_000).otherwise(0)
    )
    rotated = F.concat(F.substring("text", F.lit(2), F.char_length("text")), F.substring("text", 1, 1))
    content = F.when(changed & (doc % 13 == 0), rotated).otherwise(F.col("text"))
    return rows.select(
        F.concat_ws("/", folder, name).alias("path"),
        folder.alias("folder"),
        name.alias("name"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        mtime.cast("bigint").alias("mtime_us"),
        F.lit(0).alias("attributes"),
        content.alias("content"),
        "doc_id",
        "root",
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = files(spark, sf_dir).select("folder").distinct().select(F.explode(ancestors("folder")).alias("path"))
    return listed.filter("path <> '/'").distinct().select(
        "path", F.lit(True).alias("readable"), F.lit(None).cast("string").alias("reason")
    )


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(files(spark, sf_dir), folders(spark, sf_dir))


def later(spark: SparkSession, sf_dir: str) -> Catalog:
    """A later snapshot: one root offline, some files gone, some saved again."""
    doc, root = F.col("doc_id"), F.col("root")
    gone = (
        (root == "archive")
        | ((root == "backup") & (doc % 23 == 0))
        | ((root == "live") & (doc % 31 == 0))
    )
    now = files(spark, sf_dir).filter(~gone)
    saved_again = F.when(doc % 29 == 0, F.col("mtime_us") + 3_600_000_000).otherwise(F.col("mtime_us"))
    earlier = folders(spark, sf_dir).filter("path <> '/archive' and path not like '/archive/%'")
    return Catalog(now.withColumn("mtime_us", saved_again), earlier)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's roots; the archive is offline."""
    top = F.concat(F.lit("/"), F.col("root"))
    return files(spark, sf_dir).select(top.alias("root")).distinct().withColumn(
        "reachable", F.col("root") != "/archive"
    )
