"""Normalized readings on disk: one JSON object per line with camelCase names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drop_files import load_of

# Column and property name of a normalized reading.
PROPERTIES = [
    ("file_key", "fileKey"),
    ("line_number", "lineNumber"),
    ("sensor_id", "sensorId"),
    ("sensor_type", "sensorType"),
    ("timestamp", "timestamp"),
    ("value", "value"),
    ("unit", "unit"),
]

SCHEMA = "fileKey STRING, lineNumber INT, sensorId STRING, sensorType STRING, timestamp TIMESTAMP, value DOUBLE, unit STRING"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_normalized(readings: DataFrame, path: str) -> None:
    """Overwrite path with the readings as NDJSON, compressed, one writer per task. Readings of several loads go to load=N below it, and
    other loads stay."""
    loads = load_of(readings)
    named = readings.select(*[F.col(column).alias(name) for column, name in PROPERTIES], *loads)
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if loads else "static").partitionBy(*loads)
    writer.option("timestampFormat", TIMESTAMP_FORMAT).option("compression", "gzip").json(path)


def read_normalized(spark: SparkSession, path: str, below: list[str] | None = None) -> DataFrame:
    """Readings back from NDJSON; empty lines are skipped. `below` names folders load=N of the path: their rows come with load.

    The written timestamps are ISO-8601, which Spark's own parser reads; by a format every one would go through Java's.
    """
    reader = spark.read.schema(SCHEMA if below is None else f"{SCHEMA}, load BIGINT").option("mode", "FAILFAST")
    raw = reader.json(path) if below is None else reader.option("basePath", path).json([f"{path}/{folder}" for folder in below])
    return raw.select(*[F.col(name).alias(column) for column, name in PROPERTIES], *load_of(raw))
