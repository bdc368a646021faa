"""The file ledger: one event per file and run, and the views built over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lifecycle_prefix, relative_key, truncate
from ..sources.drop_files import load_of

# Fixed value: the outcome of a file that was gone when a run came to it.
MISSING = "Missing"


def ledger_events(verdicts: DataFrame, run_id: Column | str, as_of: Column, pipeline: str, pipeline_version: int) -> DataFrame:
    """Outcome of a run for each file: Stored, or Invalid with its cut error text."""
    error = F.concat(F.col("error_type"), F.lit(": "), F.col("error"))
    return verdicts.select(
        F.col("file_key").alias("key"),
        *load_of(verdicts),
        "status",
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(pipeline_version).cast("int").alias("pipeline_version"),
        "format",
        "checksum",
        "size_bytes",
        "row_count",
        "invalid_row_count",
        "stored_count",
        "failed_step",
        truncate(error).alias("error"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        as_of.alias("completed_at"),
    )


def claim_events(keys: DataFrame, run_id: Column, as_of: Column) -> DataFrame:
    """A run takes files on (key, and any further columns): status Processing, earlier failure and completion cleared."""
    nothing = lambda kind: F.lit(None).cast(kind)
    return keys.select(
        *keys.columns,
        F.lit("Processing").alias("status"),
        run_id.alias("run_id"),
        nothing("string").alias("failed_step"),
        nothing("string").alias("error"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        nothing("timestamp").alias("completed_at"),
    )


def missing_events(keys: DataFrame, run_id: Column, as_of: Column, pipeline: str, pipeline_version: int) -> DataFrame:
    """Files that were gone when a run came to them."""
    return keys.select(
        *keys.columns,
        F.lit(MISSING).alias("status"),
        run_id.alias("run_id"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(pipeline_version).cast("int").alias("pipeline_version"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
        as_of.alias("completed_at"),
    )


def latest_by_key(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins. The rank filter keeps one row per key and task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def ledger_view(events: DataFrame, order: list[str], run: str = "run_id") -> DataFrame:
    """Current row per file, with attempts (distinct runs) and the first created_at, in one pass over the events.

    Partial aggregates keep one row and the few runs of a key before the shuffle. Where events stand for earlier ones,
    `earlier_attempts` says for how many.
    """
    kept = [c for c in events.columns if c not in ("key", "created_at", "earlier_attempts")]
    earlier = F.coalesce(F.sum("earlier_attempts"), F.lit(0)) if "earlier_attempts" in events.columns else F.lit(0)
    newest = F.max_by(F.struct(*kept), F.struct(*order))
    view = events.groupBy("key").agg(
        newest.alias("_newest"), (F.size(F.collect_set(run)) + earlier).cast("int").alias("attempts"), F.min("created_at").alias("created_at")
    )
    return view.select("key", "_newest.*", "attempts", "created_at")


def error_reports(verdicts: DataFrame, as_of: Column, pipeline: str, pipeline_version: int) -> DataFrame:
    """One JSON report per rejected file."""
    body = F.to_json(
        F.struct(
            F.col("file_key").alias("file"),
            F.lit(f"{pipeline}:v{pipeline_version}").alias("pipeline"),
            F.col("failed_step").alias("failedStep"),
            F.col("error_type").alias("errorType"),
            F.col("error").alias("error"),
            F.col("completed_steps").alias("completedSteps"),
            as_of.alias("at"),
        )
    )
    return verdicts.where(F.col("status") == "Invalid").select("file_key", *load_of(verdicts), body.alias("report"))


def finalized_state(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """Where a key ended up: waiting in the inbox, processed, invalid, or missing."""
    places = (
        listing.select(relative_key(F.col("key")).alias("key"), lifecycle_prefix(F.col("key")).alias("place"))
        .groupBy("key")
        .agg(
            F.bool_or(F.col("place").isin("incoming/", "processing/")).alias("waiting"),
            F.bool_or(F.col("place") == "processed/").alias("processed"),
            F.bool_or(F.col("place") == "invalid/").alias("invalid"),
        )
    )
    state = F.when(F.col("waiting"), "waiting").when(F.col("processed"), "processed").when(F.col("invalid"), "invalid").otherwise("missing")
    return keys.join(places, "key", "left").select(*keys.columns, state.alias("finalized_as"))
