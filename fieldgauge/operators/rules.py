"""Row rules: catalog look-up, unit conversion and the ordered checks of a raw row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import sensor_types, sensor_units
from ..functions.numbers import is_finite, read_number, round4
from ..functions.text import number_text, trim_blank
from ..functions.times import parse_timestamp

RAW_FIELDS = ["sensor_id", "sensor_type", "timestamp", "value", "unit"]
MAX_ID_LENGTH = 64


def with_catalog(rows: DataFrame, type_text: Column, unit_text: Column) -> DataFrame:
    """Look up type and unit, ignoring case. Unmatched rows keep NULLs.

    The catalog is fixed: five types, fourteen units.
    """
    spark = rows.sparkSession
    types = sensor_types(spark).select(
        F.lower("sensor_type").alias("_type_key"),
        F.col("sensor_type").alias("type_name"),
        "canonical_unit",
        "min_value",
        "max_value",
        "bounds",
    )
    units = sensor_units(spark).select(
        F.lower("sensor_type").alias("_unit_type_key"), F.lower("unit").alias("_unit_key"), "pre", "mul", "div"
    )
    keyed = rows.withColumn("_t", F.lower(type_text)).withColumn("_u", F.lower(unit_text))
    return (
        keyed.join(F.broadcast(types), F.col("_t") == F.col("_type_key"), "left")
        .join(F.broadcast(units), (F.col("_t") == F.col("_unit_type_key")) & (F.col("_u") == F.col("_unit_key")), "left")
        .drop("_t", "_u", "_type_key", "_unit_type_key", "_unit_key")
    )


def converted(value: Column) -> Column:
    """Canonical value, rounded to four decimals, from the catalog columns."""
    return round4((value - F.col("pre")) * F.col("mul") / F.col("div"))


def validate_rows(raw: DataFrame, as_of: Column) -> DataFrame:
    """Check every raw row; the first failing rule gives its message, NULL means valid.

    Input: the five raw fields, and row_error / is_row where the source sets them.
    Output: the other input columns, the reading's columns as far as they could be read,
    and the message.
    """
    carried = [c for c in raw.columns if c not in RAW_FIELDS and c != "row_error"]
    row_error = F.col("row_error") if "row_error" in raw.columns else F.lit(None).cast("string")
    is_row = F.col("is_row") if "is_row" in raw.columns else F.lit(True)
    staged = raw.select(
        *carried,
        row_error.alias("row_error"),
        trim_blank(F.col("sensor_id")).alias("_id"),
        trim_blank(F.col("sensor_type")).alias("_type"),
        trim_blank(F.col("unit")).alias("_unit"),
        F.col("timestamp").alias("_ts_text"),
        F.col("value").alias("_value_text"),
        parse_timestamp(F.col("timestamp")).alias("_ts"),
        read_number(F.col("value")).alias("_raw"),
    )
    joined = with_catalog(staged, F.col("_type"), F.col("_unit")).withColumn("_value", converted(F.col("_raw")))
    quoted = lambda text, before, after: F.concat(F.lit(before), text, F.lit(after))
    message = (
        F.when(~is_row, F.lit(None).cast("string"))
        .when(F.col("row_error").isNotNull(), F.col("row_error"))
        .when(
            ~F.coalesce(F.char_length("_id").between(1, MAX_ID_LENGTH), F.lit(False)),
            f"sensor_id is required (max {MAX_ID_LENGTH} chars)",
        )
        .when(F.col("type_name").isNull(), quoted(F.coalesce("_type", F.lit("")), "Unknown sensor_type '", "'"))
        .when(F.col("_ts").isNull(), quoted(F.coalesce("_ts_text", F.lit("")), "Invalid timestamp '", "'"))
        .when(F.col("_ts") > as_of + F.expr("INTERVAL 1 DAY"), quoted(F.col("_ts_text"), "Timestamp '", "' is in the future"))
        .when(~is_finite(F.col("_raw")), quoted(F.coalesce("_value_text", F.lit("")), "Invalid value '", "'"))
        .when(
            F.col("pre").isNull(),
            F.concat(F.lit("Unit '"), F.coalesce("_unit", F.lit("")), F.lit("' not supported for "), F.col("type_name")),
        )
        .when(
            ~F.col("_value").between(F.col("min_value"), F.col("max_value")),
            F.concat(
                F.lit("Value "),
                number_text(F.col("_value")),
                F.col("canonical_unit"),
                F.lit(" outside "),
                F.col("bounds"),
            ),
        )
    )
    return joined.select(
        *carried,
        F.col("_id").alias("sensor_id"),
        F.col("type_name").alias("sensor_type"),
        F.col("_ts").alias("timestamp"),
        F.col("_value").alias("value"),
        F.col("canonical_unit").alias("unit"),
        message.alias("message"),
    )


def valid_readings(validated: DataFrame) -> DataFrame:
    """The readings alone: data rows without a message."""
    rows = validated.where("is_row") if "is_row" in validated.columns else validated
    kept = ["file_key", "load", "line_number", *RAW_FIELDS]
    return rows.where(F.col("message").isNull()).select(*[c for c in kept if c in validated.columns])


def row_issues(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("message").isNotNull()).select("file_key", "line_number", "message")
