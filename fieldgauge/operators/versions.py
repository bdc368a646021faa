"""Append-only versions of named rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import latest_by_key


def latest_versions(rows: DataFrame, key: str = "name", version: str = "version") -> DataFrame:
    """The newest version of every name."""
    return latest_by_key(rows, [key], [version])


def get_version(rows: DataFrame, name, number: int | None = None, key: str = "name", version: str = "version") -> DataFrame:
    """One exact version of a name, or its newest."""
    mine = rows.where(F.col(key) == name)
    return mine.where(F.col(version) == number) if number is not None else mine.orderBy(F.desc(version)).limit(1)


def version_history(rows: DataFrame, name=None, key: str = "name", version: str = "version") -> DataFrame:
    """All versions of one name, or of all names, newest first."""
    kept = rows if name is None else rows.where(F.col(key) == name)
    return kept.orderBy(key, F.desc(version))


def next_versions(rows: DataFrame, names: DataFrame, key: str = "name", version: str = "version") -> DataFrame:
    """The number the next save of each name gets; 1 for a name never seen."""
    newest = rows.groupBy(key).agg(F.max(version).alias("_newest"))
    return names.select(key).distinct().join(newest, key, "left").select(key, (F.coalesce("_newest", F.lit(0)) + 1).alias("next_version"))


def append_version(rows: DataFrame, new: DataFrame, key: str = "name", version: str = "version", order: str | None = None) -> DataFrame:
    """The new rows with the version numbers they are saved under.

    Several new rows of a name get consecutive numbers in `order`.
    """
    position = F.lit(1)
    if order is not None:
        position = F.row_number().over(Window.partitionBy(key).orderBy(order))
    newest = rows.groupBy(key).agg(F.max(version).alias("_newest"))
    numbered = new.drop(version).withColumn("_position", position).join(newest, key, "left")
    return numbered.withColumn(version, F.coalesce("_newest", F.lit(0)) + F.col("_position")).drop("_newest", "_position")
