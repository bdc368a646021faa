"""Categories, per-sensor results, histograms, and job totals and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import type_names
from ..functions.numbers import mean4
from ..functions.text import job_key
from ..functions.thresholds import CATEGORIES, PARAMETER_PREFIX, category, parse_thresholds, with_thresholds
from .batches import uncategorized

MEASUREMENT_STATE = ["category", "categorized_at", "categorized_by_job"]


def check_types(types: list[str], known: list[str] | None = None) -> list[str]:
    """Unknown types refuse the request as a whole."""
    names = {name.lower() for name in (known or type_names())}
    unknown = [t for t in types if t.lower() not in names]
    if unknown:
        raise ValueError(f"Unknown sensor types: {', '.join(unknown)}")
    return types


def try_categorize(rows: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
    """Set category by the thresholds of each row's type, and step_error where that cannot be done: the type's thresholds
    cannot be read, or the row has no number."""
    kept = [c for c in rows.columns if c not in ("category", "step_error")]
    leveled = with_thresholds(rows.select(*kept), parameters)
    unread = F.col("value").isNull() | F.isnan("value")
    error = F.coalesce(F.col("threshold_error"), F.when(unread, F.concat(F.lit("Measurement "), F.col("id").cast("string"), F.lit(" has no value"))))
    named = category(F.col("value"), F.col("low"), F.col("high"), F.col("critical"))
    return leveled.select(*kept, F.when(error.isNull(), named).alias("category"), error.alias("step_error"))


def check_thresholds(parameters: dict[str, str] | None) -> None:
    """Thresholds that cannot be read are an error."""
    for name, text in (parameters or {}).items():
        if name.startswith(PARAMETER_PREFIX):
            parse_thresholds(text)


def categorize(rows: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
    """Set category by the thresholds of each row's type; thresholds that cannot be read refuse the request."""
    check_thresholds(parameters)
    kept = [c for c in rows.columns if c != "category"]
    leveled = with_thresholds(rows.select(*kept), parameters)
    return leveled.select(*kept, category(F.col("value"), F.col("low"), F.col("high"), F.col("critical")).alias("category"))


def failed_batches(errors: DataFrame, step: str, keys: tuple[str, ...] = ("sensor_type", "batch_number")) -> DataFrame:
    """Rows with step_error folded to one row per batch: the step and its first error, by id."""
    return errors.where("step_error is not null").groupBy(*keys).agg(F.lit(step).alias("failed_step"), F.min_by("step_error", "id").alias("error"))


def failed_batch_sizes(batched: DataFrame, failed: DataFrame, keys: tuple[str, ...] = ("sensor_type", "batch_number")) -> DataFrame:
    """The failed batches with all their rows counted. Spark broadcasts the few failed batches; none costs no join."""
    rows = batched.join(failed.select(*keys).distinct(), list(keys), "left_semi").groupBy(*keys).agg(F.count("*").alias("rows"))
    return failed.join(rows, list(keys))


def stamp(categorized: DataFrame, job: Column, as_of: Column) -> DataFrame:
    """Record when and by which job; the category is already a column of the row."""
    return categorized.withColumn("categorized_at", as_of).withColumn("categorized_by_job", job)


def apply_categories(measurements: DataFrame, staged: DataFrame, job: Column, as_of: Column) -> DataFrame:
    """Update measurements from staged (id, category); rows not staged stay as they are."""
    fresh = staged.select(F.col("id").alias("_id"), F.col("category").alias("_category"))
    hit = F.col("_id").isNotNull()
    updates = {"category": F.col("_category"), "categorized_at": as_of, "categorized_by_job": job}
    return measurements.join(fresh, measurements["id"] == F.col("_id"), "left").select(
        *[c for c in measurements.columns if c not in updates],
        *[F.when(hit, new).otherwise(F.col(name)).alias(name) for name, new in updates.items()],
    )


def categorize_in_place(measurements: DataFrame, parameters: dict[str, str] | None, job: Column, as_of: Column) -> DataFrame:
    """The measurements with those a job may take categorized and stamped, in one pass: a type's thresholds do not depend on batches,
    so nothing is staged and joined back."""
    hit = uncategorized(job)
    leveled = with_thresholds(measurements, parameters)
    named = category(F.col("value"), F.col("low"), F.col("high"), F.col("critical"))
    updates = {"category": named, "categorized_at": as_of, "categorized_by_job": job}
    return leveled.select(*[c for c in measurements.columns if c not in updates], *[F.when(hit, new).otherwise(F.col(name)).alias(name) for name, new in updates.items()])


def staged_rows(staged: DataFrame, measurements: DataFrame) -> DataFrame:
    """Staged categories joined back to their measurements by id."""
    return staged.select("id", "category", "batch_number").join(measurements.select("id", "sensor_type", "sensor_id", "value"), "id")


def per_sensor_results(categorized: DataFrame, keys: tuple[str, ...] = ("sensor_type", "batch_number", "sensor_id")) -> DataFrame:
    """Count, bounds, mean and category counts per batch and sensor."""
    category_counts = [F.count_if(F.col("category") == name).alias(f"{name.lower()}_count") for name in CATEGORIES]
    return categorized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        mean4(F.col("value")).alias("avg"),
        *category_counts,
    )


def category_histogram(categorized: DataFrame, keys: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    return categorized.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("count"))


def histogram_map(histogram: DataFrame, keys: tuple[str, ...] = ("sensor_type",)) -> DataFrame:
    """The histogram as one map per job; at most four entries each."""
    return histogram.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", "count"))).alias("categories"))


def job_totals(ranges: DataFrame, base: Column | str, failed: DataFrame | None = None) -> DataFrame:
    """Processed rows, batches and failed batches per job, from the batch ranges. Which batches failed is a column `failed` of theirs,
    or a table of its own."""
    marked = ranges.withColumn("_failed", F.col("failed") if "failed" in ranges.columns else F.lit(False))
    if failed is not None:
        marks = failed.select("sensor_type", "batch_number").distinct().withColumn("_mark", F.lit(True))
        marked = marked.join(marks, ["sensor_type", "batch_number"], "left").withColumn("_failed", F.coalesce("_mark", "_failed"))
    totals = marked.groupBy("sensor_type").agg(
        F.sum("count").alias("processed"),
        F.count(F.lit(1)).alias("batches"),
        F.count_if("_failed").alias("failed_batches"),
        F.max("last_id").alias("cursor"),
    )
    return totals.select(job_key(base, F.col("sensor_type")).alias("job_id"), "sensor_type", "processed", "batches", "failed_batches", "cursor")


def job_progress(ranges: DataFrame) -> DataFrame:
    """Cursor, batches and processed rows after each batch of a job."""
    return ranges.select(
        "sensor_type", "batch_number", F.col("last_id").alias("cursor"), F.col("batch_number").alias("batches"), "processed"
    )
