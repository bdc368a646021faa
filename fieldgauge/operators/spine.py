"""Entity by day: every entity on every day, with what happened on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_days(entities: DataFrame, entity: str, first_day: str, days: int) -> DataFrame:
    """Each entity's days as generated rows, map-side."""
    start = F.lit(first_day).cast("date")
    return entities.select(entity, F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("day"))


def entity_day_summary(facts: DataFrame, entities: DataFrame, entity: str, ts: str, file_key: str, first_day: str, days: int) -> DataFrame:
    """Files and measurements per entity and day, 0 where there are none.

    Facts are first counted per (entity, day, file), so a busy entity is combined before
    anything is shuffled and no distinct set is held.
    """
    start = F.lit(first_day).cast("date")
    day = F.to_date(ts)
    in_span = facts.where((day >= start) & (day <= F.date_add(start, days - 1)))
    per_file = in_span.groupBy(entity, day.alias("day"), file_key).agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_file.groupBy(entity, "day").agg(F.count(F.lit(1)).alias("files"), F.sum("_n").alias("measurements"))
    spine = entity_days(entities, entity, first_day, days)
    return spine.join(per_day, [entity, "day"], "left").select(
        entity, "day", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("measurements", F.lit(0)).alias("measurements")
    )
