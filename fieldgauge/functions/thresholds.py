"""Category thresholds: parsing, look-up per type, and the category itself."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import DEFAULT_THRESHOLDS, fixed_table
from .numbers import parse_number

# The category names.
CATEGORIES = ["LOW", "NORMAL", "HIGH", "CRITICAL"]

PARAMETER_PREFIX = "thresholds."

# A type without thresholds is always NORMAL.
OPEN_THRESHOLDS = (-sys.float_info.max, sys.float_info.max, sys.float_info.max)


def parse_thresholds(text: str) -> tuple[float, float, float]:
    """'low;high;critical' in ascending order."""
    try:
        low, high, critical = (float(part) for part in text.replace(",", ";").split(";"))
    except ValueError:
        low, high, critical = 1.0, 0.0, 0.0
    if not low <= high <= critical:
        raise ValueError(f"Invalid thresholds '{text}', expected 'low;high;critical' in ascending order")
    return low, high, critical


def threshold_struct(text: Column) -> Column:
    """The same for a text column: a struct, or an error that fails the query."""
    numbers = F.transform(F.split(text, "[;,]"), parse_number)
    low, high, critical = (F.try_element_at(numbers, F.lit(i)) for i in (1, 2, 3))
    good = (F.size(numbers) == 3) & (low <= high) & (high <= critical)
    message = F.concat(F.lit("Invalid thresholds '"), text, F.lit("', expected 'low;high;critical' in ascending order"))
    parsed = F.struct(low.alias("low"), high.alias("high"), critical.alias("critical"))
    return F.when(text.isNull() | F.coalesce(good, F.lit(False)), parsed).otherwise(
        F.raise_error(message).cast("struct<low:double,high:double,critical:double>")
    )


def threshold_table(spark, parameters: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(explicit, default) thresholds. Parameter names match exactly, defaults ignore case. An explicit text that cannot be read
    gives its type an error in place of numbers."""
    explicit = []
    for name, text in sorted((parameters or {}).items()):
        if name.startswith(PARAMETER_PREFIX):
            try:
                explicit.append((name[len(PARAMETER_PREFIX) :], *parse_thresholds(text), None))
            except ValueError as wrong:
                explicit.append((name[len(PARAMETER_PREFIX) :], None, None, None, str(wrong)))
    columns = ["threshold_type", "low", "high", "critical"]
    given = spark.createDataFrame(explicit, "threshold_type string, low double, high double, critical double, error string")
    return given, fixed_table(spark, DEFAULT_THRESHOLDS, columns)


def with_thresholds(rows: DataFrame, parameters: dict[str, str] | None = None) -> DataFrame:
    """Add low, high, critical and threshold_error to rows by sensor_type: parameter, else default, else open.

    Both tables hold one row per parameter or per catalog type, so they are broadcast.
    """
    given, defaults = threshold_table(rows.sparkSession, parameters)
    given = given.select("threshold_type", F.struct("low", "high", "critical", "error").alias("_given"))
    no_error = F.lit(None).cast("string").alias("error")
    defaults = defaults.select(F.col("threshold_type").alias("_default_type"), F.struct("low", "high", "critical", no_error).alias("_default"))
    open_range = F.struct(*[F.lit(v).alias(n) for n, v in zip(("low", "high", "critical"), OPEN_THRESHOLDS)], no_error)
    joined = (
        rows.join(F.broadcast(given), rows["sensor_type"] == given["threshold_type"], "left")
        .join(F.broadcast(defaults), F.lower(rows["sensor_type"]) == defaults["_default_type"], "left")
        .withColumn("_t", F.coalesce("_given", "_default", open_range))
    )
    return joined.select(*[rows[c] for c in rows.columns], "_t.low", "_t.high", "_t.critical", F.col("_t.error").alias("threshold_error"))


def category(value: Column, low: Column, high: Column, critical: Column) -> Column:
    return (
        F.when(value >= critical, "CRITICAL").when(value >= high, "HIGH").when(value < low, "LOW").otherwise("NORMAL")
    )
