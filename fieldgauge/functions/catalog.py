"""Sensor types, their units and bounds, as small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .text import plain_number

# Type, canonical unit, lowest and highest accepted value.
SENSOR_TYPES = [
    ("temperature", "C", -90.0, 150.0),
    ("humidity", "%", 0.0, 100.0),
    ("pressure", "hPa", 300.0, 1100.0),
    ("vibration", "mm/s", 0.0, 200.0),
    ("co2", "ppm", 0.0, 10000.0),
]

# Type, unit and the terms of (v - pre) * mul / div.
SENSOR_UNITS = [
    ("temperature", "C", 0.0, 1.0, 1.0),
    ("temperature", "F", 32.0, 5.0, 9.0),
    ("temperature", "K", 273.15, 1.0, 1.0),
    ("humidity", "%", 0.0, 1.0, 1.0),
    ("humidity", "ratio", 0.0, 100.0, 1.0),
    ("pressure", "hPa", 0.0, 1.0, 1.0),
    ("pressure", "Pa", 0.0, 1.0, 100.0),
    ("pressure", "kPa", 0.0, 10.0, 1.0),
    ("pressure", "bar", 0.0, 1000.0, 1.0),
    ("vibration", "mm/s", 0.0, 1.0, 1.0),
    ("vibration", "m/s", 0.0, 1000.0, 1.0),
    ("vibration", "in/s", 0.0, 25.4, 1.0),
    ("co2", "ppm", 0.0, 1.0, 1.0),
    ("co2", "%", 0.0, 10000.0, 1.0),
]

# Default thresholds low, high, critical.
DEFAULT_THRESHOLDS = [
    ("temperature", 5.0, 30.0, 45.0),
    ("humidity", 20.0, 70.0, 90.0),
    ("pressure", 980.0, 1030.0, 1050.0),
    ("vibration", 0.5, 10.0, 25.0),
    ("co2", 350.0, 1000.0, 2000.0),
]


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def fixed_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A handful of constant rows as a local relation: no job, known size."""
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def sensor_types(spark: SparkSession) -> DataFrame:
    """Types with their bounds, also as the text a range message shows."""
    rows = [(*row, f"[{plain_number(row[2])}, {plain_number(row[3])}]") for row in SENSOR_TYPES]
    return fixed_table(spark, rows, ["sensor_type", "canonical_unit", "min_value", "max_value", "bounds"])


def sensor_units(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, SENSOR_UNITS, ["sensor_type", "unit", "pre", "mul", "div"])


def type_names() -> list[str]:
    return [row[0] for row in SENSOR_TYPES]
