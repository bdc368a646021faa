"""Status counts and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lifecycle_prefix, relative_key

FILES_TAKE = (1, 1000)
RESULTS_TAKE = (1, 5000)
JOBS_TAKE = 200


def _take(asked: int, limits: tuple[int, int]) -> int:
    return max(limits[0], min(asked, limits[1]))


def files_per_status(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def measurements_per_type(measurements: DataFrame) -> DataFrame:
    return measurements.groupBy("sensor_type").agg(F.count(F.lit(1)).alias("total"), F.count("category").alias("categorized"))


def list_files(files: DataFrame, status: str | None = None, take: int = 100) -> DataFrame:
    """Files by last update, newest first; an empty status means all."""
    kept = files.where(F.col("status") == status) if status else files
    return kept.orderBy(F.desc("updated_at"), "key").limit(_take(take, FILES_TAKE))


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(JOBS_TAKE)


def job_view(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def list_results(results: DataFrame, job_id: str, take: int = 100) -> DataFrame:
    ordered = results.where(F.col("job_id") == job_id).orderBy("batch_number", "sensor_id")
    return ordered.limit(_take(take, RESULTS_TAKE))


def file_status(files: DataFrame, listing: DataFrame, key: str | None = None) -> DataFrame:
    """Ledger row of a file with every place it lies in; a missing part stays NULL.

    A key lies in at most five places, one per life-cycle prefix.
    """
    places = listing.select(
        relative_key(F.col("key")).alias("key"), F.struct(F.col("key").alias("location"), F.col("tags").alias("tags")).alias("_at")
    ).where(lifecycle_prefix(F.col("_at.location")).isin("incoming/", "processing/", "processed/", "invalid/"))
    if key is not None:
        wanted = relative_key(F.lit(key))
        files, places = files.where(F.col("key") == wanted), places.where(F.col("key") == wanted)
    located = places.groupBy("key").agg(F.map_from_entries(F.collect_list("_at")).alias("objects"))
    return files.join(located, "key", "full" if key is not None else "left")
