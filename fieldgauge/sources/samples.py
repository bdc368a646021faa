"""Sample files: numeric CSV with a header, and pipe-separated report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import size_text_bytes

# Columns of the sample files.
START_SAMPLES = ["elapsed_s", "started_total", "starts_per_s", "lat_p50_ms", "lat_p99_ms", "lat_max_ms", "errors_total"]
VEHICLE_SAMPLES = ["elapsed_s", "vehicles_started", "vehicles_done", "days_done", "days_per_s", "errors_total"]


def read_samples(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A numeric CSV with a header line; every field is a double, and a bad one an error."""
    schema = ", ".join(f"`{name}` DOUBLE" for name in columns)
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_report_lines(spark.read.text(path))


def parse_report_lines(lines: DataFrame) -> DataFrame:
    """Sort report lines into three kinds by their shape and drop the rest.

    size: db_size_mb|N; table: name|rows|size; statement: mean|calls|query.
    """
    parts = F.split("value", r"\|")
    first, second, third = (F.try_element_at(F.col("_p"), F.lit(i)) for i in (1, 2, 3))
    three = F.size("_p") == 3
    kind = (
        F.when(first == "db_size_mb", "size")
        .when(three & first.rlike("^[a-z_]+$") & second.rlike("^[0-9]+$"), "table")
        .when(three & first.rlike("^[0-9.]+$"), "statement")
    )
    is_table, is_statement = F.col("kind") == "table", F.col("kind") == "statement"
    return (
        lines.select("value", parts.alias("_p"))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "kind",
            F.when(F.col("kind") == "size", second.try_cast("double")).alias("db_size_mb"),
            F.when(is_table, first).alias("table_name"),
            F.when(is_table, second.try_cast("bigint")).alias("row_count"),
            F.when(is_table, third).alias("size_text"),
            F.when(is_table, size_text_bytes(third)).alias("size_bytes"),
            F.when(is_statement, first.try_cast("double")).alias("mean_ms"),
            F.when(is_statement, second.try_cast("bigint")).alias("calls"),
            F.when(is_statement, third).alias("query_text"),
        )
    )


def largest_tables(report: DataFrame, take: int | None = None) -> DataFrame:
    """Tables by size, largest first."""
    ordered = report.where(F.col("kind") == "table").orderBy(F.desc("size_bytes"), "table_name")
    ordered = ordered.limit(take) if take else ordered
    return ordered.select("table_name", "row_count", "size_text", "size_bytes")


def top_statements(report: DataFrame, take: int = 12) -> DataFrame:
    """Statements by total time."""
    rows = report.where(F.col("kind") == "statement").withColumn("total_ms", F.col("mean_ms") * F.col("calls"))
    return rows.orderBy(F.desc("total_ms"), "query_text").limit(take).select("mean_ms", "calls", "query_text", "total_ms")
