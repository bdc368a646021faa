"""Dispatch: which listed files to start, and which stuck ones to start again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..functions.text import relative_key
from ..functions.times import minutes_before


def dispatch_plan(listing: DataFrame, in_flight: DataFrame, max_files: int = 2000, max_in_flight: int = 0) -> DataFrame:
    """State of each candidate: dispatched, already_running or throttled.

    Candidates are the first max_files keys of the listing, a distributed top-k; all
    later steps work on at most max_files + 1 rows. One row more tells that there are more.
    """
    first = listing.select("key", relative_key(F.col("key")).alias("relative")).orderBy("key").limit(max_files + 1)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy("key")))
    keys = in_flight.select(F.col("key").alias("relative"))
    running = keys.join(F.broadcast(numbered.select("relative")), "relative", "left_semi").distinct().withColumn("_running", F.lit(True))
    budget = F.lit(max_files)
    if max_in_flight > 0:
        count = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
        budget = clamp(F.lit(max_in_flight) - count, 0, max_files)
    fresh = F.when(F.col("_running"), 0).otherwise(1)
    started = F.sum(fresh).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return (
        numbered.join(running, "relative", "left")
        .withColumn("_running", F.coalesce("_running", F.lit(False)))
        .withColumn("_before", F.coalesce(started, F.lit(0)))
        .withColumn("_budget", budget)
        .select(
            "key",
            "position",
            F.when(F.col("position") > max_files, "beyond")
            .when(F.col("_before") >= F.col("_budget"), "throttled")
            .when(F.col("_running"), "already_running")
            .otherwise("dispatched")
            .alias("state"),
        )
    )


def dispatched(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("state") == "dispatched").select("key")


def dispatch_counts(plan: DataFrame) -> DataFrame:
    """Counters of one scan."""
    state = lambda name: F.count_if(F.col("state") == name)
    counts = plan.agg(
        F.count_if(F.col("state") != "beyond").alias("listed"),
        state("dispatched").alias("dispatched"),
        state("already_running").alias("already_running"),
        state("throttled").alias("throttled"),
        state("beyond").alias("_beyond"),
    )
    more = (F.col("_beyond") > 0) & (F.col("dispatched") > 0) & (F.col("throttled") == 0)
    return counts.select("listed", "dispatched", "already_running", "throttled", more.alias("has_more"))


def stuck_files(listing: DataFrame, minutes: int, as_of: Column) -> DataFrame:
    """Files in processing/ untouched for longer than the given minutes."""
    return listing.where(F.col("key").startswith("processing/") & (F.col("last_modified") < minutes_before(as_of, minutes)))


def orphans(listing: DataFrame, in_flight: DataFrame, minutes: int, as_of: Column) -> DataFrame:
    """Stuck files that nothing is working on."""
    stuck = stuck_files(listing, minutes, as_of).select(relative_key(F.col("key")).alias("key"), "last_modified")
    return stuck.join(in_flight.select("key").distinct(), "key", "left_anti")


def scan_totals(scans: DataFrame) -> DataFrame:
    """Totals over a log of scans (rows of dispatch_counts plus re_dispatched)."""
    return scans.agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.coalesce(F.sum("dispatched"), F.lit(0)).alias("total_dispatched"),
        F.coalesce(F.sum("re_dispatched"), F.lit(0)).alias("total_re_dispatched"),
    )
