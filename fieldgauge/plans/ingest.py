"""Ingestion: drop files to stored measurements, rejects and ledger events."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import error_reports, ledger_events, missing_events
from ..operators.rules import valid_readings, validate_rows
from ..operators.store import SensorStore, of_claim, part_of
from ..operators.verdicts import file_profile, open_verdict, with_status
from ..sources.drop_files import MAX_BYTES, as_files, fetch, load_of, parse_rows
from ..sources.listing import empty_objects, existing_paths, few_listing_tasks, file_count, key_under, parts_of, scan_folder
from ..sources.normalized import read_normalized, write_normalized
from .steps import FILE_INGESTION, Definition, run_steps


@dataclass
class LoadPlan:
    """Frames of one load: all checked rows, one verdict per file, the rows to store."""

    validated: DataFrame
    verdicts: DataFrame
    readings: DataFrame


def verdicts_of(validated: DataFrame, definition: Definition) -> DataFrame:
    return with_status(run_steps(open_verdict(file_profile(validated)), definition).rows)


def stored_readings(validated: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Valid rows of stored files. No hint: a load's verdicts are small, Spark checks their size."""
    key = ["file_key", *load_of(verdicts)]
    stored = verdicts.where(F.col("status") == "Stored").select(*key)
    return valid_readings(validated).join(stored, key, "left_semi")


def size_limit(definition: Definition) -> int | None:
    """Largest file the fetch step takes; None where the step is off."""
    fetching = definition.step("ingest.fetch")
    return int(fetching.number("maxBytes", MAX_BYTES)) if fetching else None


def plan_load(files: DataFrame, as_of: Column, definition: Definition = FILE_INGESTION) -> LoadPlan:
    """Plan a load from (file_key, size_bytes, content)."""
    validated = validate_rows(parse_rows(fetch(files, size_limit(definition))), as_of)
    verdicts = verdicts_of(validated, definition)
    return LoadPlan(validated, verdicts, stored_readings(validated, verdicts))


def with_all_ids(readings: DataFrame, verdicts: DataFrame, first: int, loads: list[int]) -> tuple[DataFrame, list[int]]:
    """Readings of several loads with their ids, as `with_ids` gives them load after load, and the last id up to each load."""
    stored = verdicts.where(F.col("status") == "Stored").select("load", "file_key", F.col("last_line").cast("bigint").alias("span"))
    before = F.sum("span").over(Window.orderBy("load", "file_key").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored.select("load", "file_key", (F.coalesce(before, F.lit(0)) + first - 1).alias("_start"))
    spans = {r["load"]: r["span"] for r in stored.groupBy("load").agg(F.sum("span").alias("span")).collect()}
    last = [first - 1 + n for n in accumulate(spans.get(load, 0) for load in loads)]
    numbered = readings.join(starts, ["load", "file_key"])
    return numbered.withColumn("id", F.col("_start") + F.col("line_number")).drop("_start"), last


def with_ids(readings: DataFrame, verdicts: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Readings with their ids, and the last id given out.

    A stored file takes as many ids as it has lines, files in key order from `first` on, so a row's id is its file's first one plus its
    line: the same in every attempt, without a bound on loads. The running sum is over one narrow row per file of one load.
    """
    stored = verdicts.where(F.col("status") == "Stored").select("file_key", F.col("last_line").cast("bigint").alias("span"))
    before = F.sum("span").over(Window.orderBy("file_key").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored.select("file_key", (F.coalesce(before, F.lit(0)) + first - 1).alias("_start"))
    last = first - 1 + (stored.agg(F.sum("span")).first()[0] or 0)
    numbered = readings.join(starts, "file_key")
    return numbered.withColumn("id", F.col("_start") + F.col("line_number")).drop("_start"), last


def ingest_load(
    store: SensorStore,
    files: DataFrame,
    source: str,
    definition: Definition = FILE_INGESTION,
    as_of: datetime | None = None,
    missing: DataFrame | None = None,
) -> int | None:
    """Ingest files as one load. Repeating a committed source does nothing.

    The files are claimed first and the ledger is written last: a load cut short in between shows as Processing, and the next call
    for its source is the next attempt. Where the definition converts, the valid rows of stored files are written as normalized
    files and the store is filled from those, under the same commit. `missing` (key) are files that are gone.
    """
    if store.committed(source):
        return None
    now = F.lit(as_of or datetime.now(timezone.utc))
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    claim = store.claim(source, files.select(F.col("file_key").alias("key"), path.alias("path")), now)
    plan = plan_load(files.drop("path"), now, definition)
    plan.validated.persist(StorageLevel.MEMORY_AND_DISK)
    plan.verdicts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        readings = plan.readings
        if definition.step("ingest.convert"):
            write_normalized(readings, store.converted_path(claim.load))
            readings = read_normalized(store.spark, store.converted_path(claim.load))
        readings, last_id = with_ids(readings, plan.verdicts, store.next_id())
        store.write_load(claim.load, readings)
        store.write_reports(claim.load, error_reports(plan.verdicts, now, definition.name, definition.version))
        events = ledger_events(plan.verdicts, source, now, definition.name, definition.version)
        if missing is not None:
            gone = missing_events(missing, F.lit(source), now, definition.name, definition.version)
            events = events.unionByName(gone, allowMissingColumns=True)
        store.commit_load(claim, events, last_id)
    finally:
        plan.verdicts.unpersist()
        plan.validated.unpersist()
    return claim.load


def ingest_loads(
    store: SensorStore,
    files: DataFrame,
    sources: list[str],
    definition: Definition = FILE_INGESTION,
    as_of: datetime | None = None,
    missing: DataFrame | None = None,
) -> list[int]:
    """Ingest files as several loads, none of which is committed, in one pass: what `ingest_load` does for each of them in turn.

    `part` of the files, and of the `missing` (part, key), says which source they go to. Every load has its own claim, folders, ledger
    rows and ids; the files are read, checked and written once for all of them, as a pass over few files costs as much as one over many.
    """
    now = F.lit(as_of or datetime.now(timezone.utc))
    claims = store.claim_all(sources, files.select("part", F.col("file_key").alias("key"), "path"), now)
    loads = [claim.load for claim in claims]
    load = (F.col("part") + loads[0]).cast("bigint").alias("load")
    plan = plan_load(files.select(load, "*").drop("part", "path"), now, definition)
    plan.validated.persist(StorageLevel.MEMORY_AND_DISK)
    plan.verdicts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The reports are first: what follows finds checked rows and verdicts there, and no task waits for another that parses the same file.
        store.write_all_reports(claims, error_reports(plan.verdicts, now, definition.name, definition.version))
        readings = plan.readings
        if definition.step("ingest.convert"):
            # A load's rows go to one task, and so to one file.
            dealt = readings.select(part_of(claims), "*").repartitionById(len(loads), "part").drop("part")
            write_normalized(dealt, store.path("converted"))
            folders = [f"load={n}" for n in loads if store._exists(store.converted_path(n))]
            readings = read_normalized(store.spark, store.path("converted"), folders) if folders else readings.where("false")
        readings, last_ids = with_all_ids(readings, plan.verdicts, store.next_id(), loads)
        store.write_all_loads(claims, readings)
        source = of_claim(claims, part_of(claims))["source"]
        events = ledger_events(plan.verdicts, source, now, definition.name, definition.version)
        if missing is not None:
            gone = missing_events(missing.select("key", load), source, now, definition.name, definition.version)
            events = events.unionByName(gone, allowMissingColumns=True)
        store.commit_all(claims, events, last_ids)
    finally:
        plan.verdicts.unpersist()
        plan.validated.unpersist()
    return loads


KeyOf = Callable[[Column], Column] | None


def empty_files(scan: DataFrame, root: str, key_of: KeyOf = None) -> DataFrame:
    """Zero-byte files as rows; the file scan leaves them out."""
    return empty_objects(scan, root).select(
        (key_of(F.col("key")) if key_of else F.col("key")).alias("file_key"),
        F.lit(0).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("last_modified"),
        F.lit("").cast("binary").alias("content"),
        "path",
    )


def folder_files(spark: SparkSession, folder: str, key_of: KeyOf = None, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Every file below a folder, empty ones too.

    Their sizes are asked once, so that what reads them has few tasks, and no second scan for large or empty files where there are none.
    """
    return sized_files(scan_folder(spark, folder), folder, key_of, max_bytes)


def sized_files(scan: DataFrame, root: str, key_of: KeyOf, max_bytes: int | None) -> DataFrame:
    spark, listed = scan.sparkSession, file_count(scan)
    lengths = scan.select("length").coalesce(parts_of(spark, listed, 0))
    zero = F.lit(0)
    found = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), zero).alias("size"), F.coalesce(F.max("length"), zero).alias("most")).first()
    limit = max_bytes if max_bytes is not None and found["most"] > max_bytes else None
    files = as_files(scan, root, key_of, limit, parts_of(spark, listed, found["size"]))
    return files if found["n"] == listed else files.unionByName(empty_files(scan, root, key_of))


def literal(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def named_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of a claim: its paths are at most one load's. Names are taken literally; a file that goes in the meantime is left out."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    with few_listing_tasks(spark):
        return reader.load([literal(path) for path in paths])


def named_files(spark: SparkSession, root: str, paths: list[str], key_of: KeyOf = None, max_bytes: int | None = MAX_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """The files at some paths, the keys of those that are gone, and how many there are of them. The paths are one load's."""
    files, lost = found_files(spark, root, paths, key_of, max_bytes)
    gone = spark.createDataFrame([(path,) for path in lost], "path string")
    key = key_under(root, F.col("path"))
    return files, gone.select((key_of(key) if key_of else key).alias("key")), len(lost)


def found_files(spark: SparkSession, root: str, paths: list[str], key_of: KeyOf = None, max_bytes: int | None = MAX_BYTES) -> tuple[DataFrame, list[str]]:
    """The files at some paths, and those paths that name none. Paths are asked for one by one only where Spark misses one."""
    lost: list[str] = []
    try:
        scan = named_scan(spark, paths) if paths else None
    except AnalysisException as missed:
        if missed.getCondition() != "PATH_NOT_FOUND":
            raise
        found = existing_paths(spark, paths)
        lost = [path for path in paths if path not in found]
        scan = named_scan(spark, [path for path in paths if path in found]) if found else None
    return no_files(spark) if scan is None else sized_files(scan, root, key_of, max_bytes), lost


def no_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_key string, size_bytes bigint, last_modified timestamp, content binary, path string")


def ingest_folder(
    store: SensorStore,
    folder: str,
    source: str,
    definition: Definition = FILE_INGESTION,
    as_of: datetime | None = None,
    key_of: KeyOf = None,
) -> int | None:
    """Ingest everything below a folder as one load.

    For a folder of one load's size; a larger one goes through the inbox stream, which
    cuts it into loads.
    """
    return ingest_load(store, folder_files(store.spark, folder, key_of, size_limit(definition)), source, definition, as_of)


def reingest(
    store: SensorStore,
    folder: str,
    keys: list[str],
    source: str,
    definition: Definition = FILE_INGESTION,
    as_of: datetime | None = None,
) -> int | None:
    """Ingest the asked keys again; their earlier rows are replaced or withdrawn.

    A re-queue request names its files, as a dispatch plan does, so only those are read. A key without a file gets the outcome
    Missing, and keeps the rows it has.
    """
    paths = [f"{folder.rstrip('/')}/{key}" for key in keys]
    files, missing, _ = named_files(store.spark, folder, paths, None, size_limit(definition))
    return ingest_load(store, files, source, definition, as_of, missing)


def sweep(
    store: SensorStore,
    root: str,
    before: Column,
    definition: Definition = FILE_INGESTION,
    as_of: datetime | None = None,
    key_of: KeyOf = None,
) -> int:
    """Take up the files of loads that were claimed before a time and never committed; returns how many files.

    Each such load is the next attempt at its own source, so that its first writer, should it come back, is fenced off. The loop
    is over dead loads; a load's files are one claim.
    """
    abandoned = store.abandoned(before).select("source", "path")
    sources = [r["source"] for r in abandoned.select("source").distinct().orderBy("source").collect()]
    taken = 0
    for source in sources:
        paths = [r["path"] for r in abandoned.where(F.col("source") == source).select("path").distinct().orderBy("path").collect() if r["path"]]
        files, missing, _ = named_files(store.spark, root, paths, key_of, size_limit(definition))
        if ingest_load(store, files, source, definition, as_of, missing) is not None:
            taken += len(paths)
    return taken
