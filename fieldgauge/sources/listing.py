"""Object listings: what lies under a folder, without reading any content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import fixed_table
from ..functions.text import LIFECYCLE_PREFIXES, lifecycle_prefix

# Files and bytes of content of one task, and what opening a file counts as.
PART_FILES = 32
PART_BYTES = 128 << 20
FILE_BYTES = 64 << 10
TEMPORARY_PREFIX = ".tmp-"
ERROR_REPORT_SUFFIX = ".error.json"


def key_under(root: str, path: Column) -> Column:
    """A path as a key relative to the root, whatever scheme the path carries."""
    bare = re.sub(r"^[A-Za-z0-9]+:/*", "", root).strip("/")
    plain = F.regexp_replace(path, r"^[A-Za-z0-9]+:/*", "/")
    return F.regexp_replace(plain, rf"^.*?/\Q{bare}\E/", "")


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root as (path, modificationTime, length, content); listed once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def file_count(scan: DataFrame) -> int:
    """Files the scan's index holds, empty ones too; the paths stay where they are."""
    return len(scan._jdf.inputFiles())


def list_objects(spark: SparkSession, root: str, prefix: str = "", exclude_suffix: str | None = None) -> DataFrame:
    """(key, size, last_modified) of the objects below root; content is never read.

    Objects of zero bytes do not come out of Spark's scan, see empty_objects.
    """
    scan = scan_folder(spark, root)
    # No content is read, so only the number of files counts.
    listing = scan.coalesce(parts_of(spark, file_count(scan), 0)).select(
        key_under(root, F.col("path")).alias("key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )
    return visible_objects(listing, prefix, exclude_suffix)


def visible_objects(listing: DataFrame, prefix: str = "", exclude_suffix: str | None = None) -> DataFrame:
    """Prefix filter, suffix exclusion, and no half-written temporary objects."""
    kept = listing.where(~F.substring_index("key", "/", -1).startswith(TEMPORARY_PREFIX))
    if prefix:
        kept = kept.where(F.col("key").startswith(prefix))
    if exclude_suffix:
        kept = kept.where(~F.col("key").endswith(exclude_suffix))
    return kept


def empty_objects(scan: DataFrame, root: str) -> DataFrame:
    """Keys of zero-byte objects: those the scan's file index knows and its rows lack.

    The file index holds the paths on the driver already; nothing else passes there.
    """
    paths = scan.sparkSession.createDataFrame([(p,) for p in scan.inputFiles()], "path string")
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    scanned = scan.select(key_under(root, F.col("path")).alias("key"))
    return visible_objects(paths.select(key_under(root, decoded).alias("key"), decoded.alias("path")).join(scanned, "key", "left_anti"))


def existing_paths(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of a load's paths that name a file, asked of the file system one by one, a few at a time."""
    configuration, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    if not paths:
        return set()
    # An inbox is on one file system.
    system = Path(paths[0]).getFileSystem(configuration)
    with ThreadPoolExecutor(4) as pool:
        return {path for path, found in zip(paths, pool.map(lambda path: system.exists(Path(path)), paths)) if found}


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Names given to a reader in here are looked up by a task per core; Spark would make a task of every name."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts_of(spark: SparkSession, files: int, size: int) -> int:
    """Tasks for so many files: all cores are busy where there are PART_FILES a task, and a task has at most some 2,000 small files or
    PART_BYTES of content.

    Left alone, Spark counts every small file as 4 MB and makes a task, and later a part of every table, of 32 of them.
    """
    busy = min(spark.sparkContext.defaultParallelism, -(-files // PART_FILES))
    return max(1, busy, -(-(size + files * FILE_BYTES) // PART_BYTES))


def count_by_prefix(listing: DataFrame, file_prefix: str = "") -> DataFrame:
    """Objects per life-cycle prefix, error reports aside; empty prefixes count 0."""
    spark = listing.sparkSession
    prefix = lifecycle_prefix(F.col("key"))
    counts = (
        listing.where(~F.col("key").endswith(ERROR_REPORT_SUFFIX))
        .withColumn("prefix", prefix)
        .where((F.col("prefix") != "") & F.startswith(F.col("key"), F.concat("prefix", F.lit(file_prefix))))
        .groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("objects"))
    )
    prefixes = fixed_table(spark, [(p,) for p in LIFECYCLE_PREFIXES], ["prefix"])
    # At most one row per prefix on either side.
    return prefixes.join(counts, "prefix", "left").select("prefix", F.coalesce("objects", F.lit(0)).alias("objects"))


def listing_page(listing: DataFrame, size: int, token: str | None = None) -> DataFrame:
    """The next page in key order after the token; the last key is the next token."""
    after = listing.where(F.col("key") > token) if token else listing
    return after.orderBy("key").limit(size)
