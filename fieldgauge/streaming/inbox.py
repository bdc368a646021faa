"""The inbox as a stream: every new file is ingested once, in loads of bounded size."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import SensorStore
from ..sources.listing import few_listing_tasks, key_under
from ..functions.times import minutes_before
from ..plans.ingest import KeyOf, found_files, ingest_load, ingest_loads, literal, named_files, size_limit, sweep
from ..plans.steps import FILE_INGESTION, Definition

SCAN_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
INTERVAL_SECONDS = (1, 3600)
# Files of the loads that a run which takes what is there goes over in one pass.
PASS_FILES = 10_000


def check_interval(seconds: int) -> int:
    low, high = INTERVAL_SECONDS
    if not low <= seconds <= high:
        raise ValueError(f"Interval must be in [{low}, {high}] seconds")
    return seconds


def trigger_of(interval_seconds: int | None) -> dict:
    """A poll interval, or None for one scan of what is there now."""
    if interval_seconds is None:
        return {"availableNow": True}
    return {"processingTime": f"{check_interval(interval_seconds)} seconds"}


def inbox_stream(spark: SparkSession, inbox: str, max_files: int, archive: str | None = None) -> DataFrame:
    """References of the new files; a load then reads only what it takes."""
    reader = spark.readStream.format("binaryFile").schema(SCAN_SCHEMA).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", max_files)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(inbox).select("path")


def taken_files(spark: SparkSession, checkpoint: str, batch_id: int) -> list[str]:
    """Paths of a micro-batch by the stream's own logs, which are written before it runs, the oldest first; empty files too."""
    folder = literal(checkpoint.rstrip("/"))

    def offset(batch: int) -> int:
        lines = [r["value"] for r in spark.read.text(f"{folder}/offsets/{batch}").collect()] if batch >= 0 else []
        return max((int(json.loads(x)["logOffset"]) for x in lines if x.startswith('{"logOffset"')), default=-1)

    first, last = offset(batch_id - 1) + 1, offset(batch_id)
    if last < first:
        return []
    logs = [f"{folder}/sources/0/{{{n},{n}.compact}}" for n in range(first, last + 1)]
    lines = spark.read.text(logs).where(F.col("value").startswith("{"))
    entry = F.from_json("value", "path STRING, timestamp BIGINT, batchId BIGINT")
    mine = lines.select(entry.alias("entry")).where(F.col("entry.batchId").between(first, last)).select("entry.timestamp", "entry.path").distinct()
    aged = sorted((r["timestamp"] or 0, re.sub("^file:/+", "file:/", unquote(r["path"]))) for r in mine.collect())
    return list(dict.fromkeys(path for _, path in aged))


def loads_of(name: str, batch_id: int, paths: list[str], max_files: int) -> dict[str, list[str]]:
    """A micro-batch's paths cut into loads, by their sources."""
    cuts = [paths[i : i + max_files] for i in range(0, len(paths), max_files)] or [[]]
    return {f"{name}-{batch_id}" + (f".{i}" if i else ""): cut for i, cut in enumerate(cuts)}


def with_parts(files: DataFrame, cuts: list[list[str]]) -> DataFrame:
    """Files with the place of the cut that has their path. The cuts are one micro-batch's, at most PASS_FILES paths, so they are broadcast."""
    places = [(path, i) for i, cut in enumerate(cuts) for path in cut]
    placed = files.sparkSession.createDataFrame(places, "_path string, part int").coalesce(1)
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return files.join(F.broadcast(placed), plain == F.col("_path"), "left").withColumn("part", F.coalesce("part", F.lit(0))).drop("_path")


def sweep_due(store: SensorStore, now: datetime, every_seconds: int) -> bool:
    """Whether the last sweep in the scan log is so long ago. The log is in the store, so the clock goes on over restarts."""
    last = store.last_sweep()
    return last is None or now.timestamp() - last >= every_seconds


def ingest_stream(
    spark: SparkSession,
    inbox: str,
    store_root: str,
    checkpoint: str,
    definition: Definition | Callable[[], Definition] = FILE_INGESTION,
    interval_seconds: int | None = None,
    max_files: int = 2000,
    name: str = "inbox",
    as_of: datetime | None = None,
    key_of: KeyOf = None,
    archive: str | None = None,
    orphan_minutes: int | None = None,
    sweep_seconds: int = 120,
) -> StreamingQuery:
    """Start ingesting an inbox into a store.

    A load has at most max_files files. With an interval, each micro-batch is one scan and one load. Without one, what is there is taken
    without a pause between scans, so a micro-batch is as many of them as come to PASS_FILES files, each a load of its own, in one
    pass; the oldest files are in the first load. The checkpoint remembers the files taken, and a repeated micro-batch finds its loads
    committed, so every file counts once; one that was cut short is the next attempt at its load. A callable definition is asked
    again for every micro-batch.

    Empty files, which the scan leaves out, are known from the checkpoint's log of the files taken and rejected with their micro-batch.
    Files that are gone get the outcome Missing. Where the inbox keeps growing, name an archive folder and Spark moves
    finished files there.

    With `orphan_minutes`, a micro-batch first takes up files of other loads that were claimed that long ago and never committed, once in
    `sweep_seconds`. Every load leaves a row in the scan log.
    """
    store = SensorStore(spark, store_root)
    together = 1 if interval_seconds is not None else max(1, PASS_FILES // max_files)

    def load_batch(references: DataFrame, batch_id: int) -> None:
        # The claims of these loads name at most together * max_files paths.
        loads = loads_of(name, batch_id, taken_files(spark, checkpoint, batch_id), max_files)
        if len(loads) > 1:
            load_together(loads)
            return
        [(source, paths)] = loads.items()
        if store.committed(source):
            return
        current = definition() if callable(definition) else definition
        now = as_of or datetime.now(timezone.utc)
        swept = orphan_minutes is not None and sweep_due(store, now, sweep_seconds)
        # This load's own earlier attempt, if there is one, is gone on with below.
        taken = sweep(store, inbox, minutes_before(F.lit(now), orphan_minutes), current, now, key_of) if swept else 0
        gone = 0
        # Only a sweep can have committed it since it was asked for.
        if paths and not (swept and store.committed(source)):
            files, missing, gone = named_files(spark, inbox, paths, key_of, size_limit(current))
            ingest_load(store, files, source, current, now, missing if gone else None)
        store.write_scan(source, F.lit(now), {"listed": len(paths), "dispatched": len(paths) - gone, "missing": gone, "re_dispatched": taken}, swept)

    def load_together(loads: dict[str, list[str]]) -> None:
        sources = list(loads)
        done = store.committed_sources(sources)
        # All loads are claimed before the first is committed, so this one took all files, in a run with larger loads.
        whole = sources[0] in done and not store.claimed_sources(sources[1:])
        if whole or len(done) == len(sources):
            return
        current = definition() if callable(definition) else definition
        now = as_of or datetime.now(timezone.utc)
        swept = orphan_minutes is not None and sweep_due(store, now, sweep_seconds)
        taken = sweep(store, inbox, minutes_before(F.lit(now), orphan_minutes), current, now, key_of) if swept else 0
        if swept:
            done |= store.committed_sources(sources)
        left = [source for source in sources if source not in done]
        if left:
            cuts = [loads[source] for source in left]
            files, lost = found_files(spark, inbox, [path for cut in cuts for path in cut], key_of, size_limit(current))
            missing = None
            if lost:
                missing = with_parts(spark.createDataFrame([(path,) for path in lost], "path string"), cuts)
                key = key_under(inbox, F.col("path"))
                missing = missing.select("part", (key_of(key) if key_of else key).alias("key"))
            ingest_loads(store, with_parts(files, cuts), left, current, now, missing)
        gone = set(lost) if left else set()
        counts = {}
        for source in sources:
            n, m = len(loads[source]), sum(path in gone for path in loads[source])
            counts[source] = {"listed": n, "dispatched": n - m, "missing": m}
        counts[sources[0]]["re_dispatched"] = taken
        store.write_scans(counts, F.lit(now), swept)

    stream = inbox_stream(spark, inbox, together * max_files, archive).writeStream.foreachBatch(load_batch)
    # The stream goes on with the settings it is started with.
    with few_listing_tasks(spark):
        return stream.option("checkpointLocation", checkpoint).trigger(**trigger_of(interval_seconds)).start()


def sweep_stream(
    spark: SparkSession,
    inbox: str,
    store_root: str,
    checkpoint: str,
    interval_seconds: int,
    orphan_minutes: int,
    definition: Definition | Callable[[], Definition] = FILE_INGESTION,
    as_of: datetime | None = None,
    key_of: KeyOf = None,
) -> StreamingQuery:
    """Start sweeping by the clock alone, for an inbox that is quiet. It is the only writer while it sweeps."""
    store = SensorStore(spark, store_root)

    def tick(_: DataFrame, batch_id: int) -> None:
        now = as_of or datetime.now(timezone.utc)
        current = definition() if callable(definition) else definition
        taken = sweep(store, inbox, minutes_before(F.lit(now), orphan_minutes), current, now, key_of)
        store.write_scan(f"sweep-{batch_id}", F.lit(now), {"re_dispatched": taken}, True)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{check_interval(interval_seconds)} seconds").start()
