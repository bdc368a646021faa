"""Registered queries through the file system: drop folders, streams and the store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import SensorStore
from ..session import scratch_path
from ..sources.listing import list_objects
from ..streaming.categorizer import categorize_stream
from ..streaming.inbox import ingest_stream
from . import standins
from .ingest import ingest_folder
from .process import categorize_loads
from .queries_ingest import FULL, ORACLES as INGEST_ORACLES
from .queries_ingest import STORED, _readings

AS_OF = datetime(2030, 1, 1, tzinfo=timezone.utc)

# -- Spark --------------------------------------------------------------------------------


def folder_key(path: Column) -> Column:
    """The file's name is the key; the folders above it only keep listings short."""
    return F.substring_index(path, "/", -1)


def drop_folder(spark: SparkSession, sf_dir: str, only: Column | None = None) -> str:
    """The stand-in files, or some of them, put into a fresh inbox; each ends with one more line break.

    Spark's writers name files and folders themselves, so tasks put the files under their names: a thousand to a folder, each written
    beside its place and moved, so that a repeated task replaces it.
    """
    inbox = scratch_path(spark, "inbox")
    files = standins.sensor_files(spark, sf_dir)
    files = files if only is None else files.where(only)

    def put(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(inbox if ":" in inbox.split("/")[0] else f"file://{inbox}")
        folders = set()
        for batch in batches:
            for key, content in zip(batch["file_key"].to_pylist(), batch["content"].to_pylist()):
                folder = f"{root}/{key.rsplit('.', 1)[0][:-3]}"
                if folder not in folders:
                    where.create_dir(folder)
                    folders.add(folder)
                beside = f"{folder}/.tmp-{uuid.uuid4().hex}"
                with where.open_output_stream(beside, compression=None) as out:
                    out.write(content + b"\n")
                where.move(beside, f"{folder}/{key}")
            yield pa.record_batch({"files": [batch.num_rows]}, pa.schema([("files", pa.int64())]))

    files.select("file_key", "content").mapInArrow(put, "files bigint").write.format("noop").mode("overwrite").save()
    return inbox


def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_objects(spark, drop_folder(spark, sf_dir)).select(folder_key(F.col("key")).alias("file_key"), "size")


def _streamed_store(spark: SparkSession, sf_dir: str) -> SensorStore:
    root = scratch_path(spark, "store")
    query = ingest_stream(spark, drop_folder(spark, sf_dir), root, scratch_path(spark, "inbox-log"), as_of=AS_OF, key_of=folder_key)
    query.awaitTermination()
    return SensorStore(spark, root)


def inbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live measurements after streaming the inbox once."""
    return _readings(_streamed_store(spark, sf_dir).measurements())


def categorized_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories after the inbox stream and the stream that follows its ledger."""
    store = _streamed_store(spark, sf_dir)
    categorize_stream(spark, store.root, scratch_path(spark, "categories-log"), as_of=AS_OF).awaitTermination()
    return store.categorized().select("file_key", "line_number", "sensor_type", "value", "category")


def redelivered_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file delivered twice: the second load replaces the first."""
    store = SensorStore(spark, scratch_path(spark, "store"))
    inbox = drop_folder(spark, sf_dir)
    for delivery in ("first", "second"):
        ingest_folder(store, inbox, delivery, as_of=AS_OF, key_of=folder_key)
    return _readings(store.measurements())


def store_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after one load of a folder."""
    store = SensorStore(spark, scratch_path(spark, "store"))
    ingest_folder(store, drop_folder(spark, sf_dir), "folder", as_of=AS_OF, key_of=folder_key)
    return store.files().select(F.col("key").alias("file_key"), "status", "failed_step", "error", "format", "row_count", "stored_count", "attempts")


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the store after a load: processed rows per type."""
    store = SensorStore(spark, scratch_path(spark, "store"))
    ingest_folder(store, drop_folder(spark, sf_dir), "folder", as_of=AS_OF, key_of=folder_key)
    categorize_loads(store, "nightly", as_of=AS_OF)
    per_job = store.results().groupBy("job_id").agg(F.sum("count").alias("measured"), F.min("min").alias("min"), F.max("max").alias("max"))
    return store.jobs().select("job_id", "sensor_type", "status", "processed", "batches", "failed_batches").join(per_job, "job_id")


QUERIES = {
    "drop_folder_listing": folder_listing,
    "inbox_stream": inbox_stream,
    "categorized_stream": categorized_stream,
    "redelivered_store": redelivered_store,
    "store_ledger": store_ledger,
    "store_jobs": job_results,
}

# -- SQL ----------------------------------------------------------------------------------

CATEGORY = """CASE sensor_type
    WHEN 'temperature' THEN CASE WHEN value >= 45 THEN 'CRITICAL' WHEN value >= 30 THEN 'HIGH' WHEN value < 5 THEN 'LOW' ELSE 'NORMAL' END
    WHEN 'humidity' THEN CASE WHEN value >= 90 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' WHEN value < 20 THEN 'LOW' ELSE 'NORMAL' END
    WHEN 'pressure' THEN CASE WHEN value >= 1050 THEN 'CRITICAL' WHEN value >= 1030 THEN 'HIGH' WHEN value < 980 THEN 'LOW' ELSE 'NORMAL' END
    WHEN 'vibration' THEN CASE WHEN value >= 25 THEN 'CRITICAL' WHEN value >= 10 THEN 'HIGH' WHEN value < 0.5 THEN 'LOW' ELSE 'NORMAL' END
    ELSE CASE WHEN value >= 2000 THEN 'CRITICAL' WHEN value >= 1000 THEN 'HIGH' WHEN value < 350 THEN 'LOW' ELSE 'NORMAL' END END"""

ORACLES = {
    "drop_folder_listing": f"SELECT file_key, size_bytes + 1 AS size FROM ({INGEST_ORACLES['file_fetch']})",
    "inbox_stream": STORED,
    "redelivered_store": STORED,
    "categorized_stream": f"SELECT file_key, line_number, sensor_type, value, {CATEGORY} AS category FROM ({STORED})",
    "store_ledger": f"""{FULL}
SELECT file_key, CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN 'Stored' ELSE 'Invalid' END AS status,
       CASE WHEN fatal IS NOT NULL OR bad_rows IS NOT NULL THEN 'ingest.validate' END AS failed_step,
       CASE WHEN fatal IS NOT NULL THEN 'InvalidFile: ' || fatal WHEN bad_rows IS NOT NULL THEN substring('InvalidRows: ' || bad_rows, 1, 2000) END AS error,
       format, CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN total ELSE 0 END AS row_count,
       CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN total ELSE 0 END AS stored_count, 1 AS attempts
FROM verdicts""",
    "store_jobs": f"""
SELECT 'nightly-' || sensor_type AS job_id, sensor_type, 'Completed' AS status, count(*) AS processed, (count(*) + 499) // 500 AS batches,
       0 AS failed_batches, count(*) AS measured, min(value) AS min, max(value) AS max
FROM ({STORED}) GROUP BY sensor_type""",
}
