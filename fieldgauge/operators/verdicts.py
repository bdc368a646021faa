"""File verdicts: per-file counts, the issue sample, and which step rejects a file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_number
from ..sources.drop_files import load_of
from .rules import row_issues

ISSUES_KEPT = 50
ISSUES_SHOWN = 5
# Lines whose issues are gathered together before they are cut to the first ones.
BLOCK_LINES = 1 << 16


def issue_samples(validated: DataFrame, keep: int = ISSUES_KEPT) -> DataFrame:
    """The first issues of each file by line, as an array.

    The rank filter lets Spark cut each file's issues before the shuffle, so one file
    never sends more than `keep` rows per task.
    """
    by_line = Window.partitionBy("file_key").orderBy("line_number")
    return (
        row_issues(validated)
        .withColumn("_rank", F.row_number().over(by_line))
        .where(F.col("_rank") <= keep)
        .groupBy("file_key")
        .agg(F.array_sort(F.collect_list(F.struct("line_number", "message"))).alias("issues"))
    )


def file_profile(validated: DataFrame, keep: int = ISSUES_KEPT) -> DataFrame:
    """The summary and the first issues of each file in one pass over its rows, so that its content is parsed once.

    Issues are gathered by blocks of lines and cut to `keep`, then gathered by file and cut again: a list holds the issues of one block,
    or `keep` of each of a file's blocks, however long and bad the file.
    """
    file = ["file_key", *load_of(validated), "file"]
    is_row = F.col("is_row") if "is_row" in validated.columns else F.lit(True)
    issue = F.when(F.col("message").isNotNull(), F.struct("line_number", "message"))
    first = lambda lists: F.slice(F.sort_array(lists), 1, keep)
    blocks = validated.groupBy(*file, F.floor(F.coalesce("line_number", F.lit(0)) / BLOCK_LINES).alias("_block")).agg(
        F.count_if(is_row).alias("total_rows"),
        F.count_if(is_row & F.col("message").isNotNull()).alias("invalid_rows"),
        F.max("line_number").alias("last_line"),
        first(F.collect_list(issue)).alias("issues"),
    )
    files = blocks.groupBy(*file).agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("invalid_rows").alias("invalid_rows"),
        F.coalesce(F.max("last_line"), F.lit(0)).alias("last_line"),
        first(F.flatten(F.collect_list("issues"))).alias("issues"),
    )
    valid = F.col("total_rows") - F.col("invalid_rows")
    issues = F.when(F.size("issues") > 0, F.col("issues"))
    return files.select(*file[:-1], "file.*", "total_rows", "invalid_rows", valid.alias("valid_rows"), "last_line", issues.alias("issues"))


def issue_text(issues: Column, shown: int = ISSUES_SHOWN) -> Column:
    lines = F.transform(F.slice(issues, 1, shown), lambda i: F.concat(F.lit("line "), i["line_number"].cast("string"), F.lit(": "), i["message"]))
    return F.array_join(lines, " | ")


def open_verdict(profile: DataFrame) -> DataFrame:
    """A file's summary and issues, no step failed yet."""
    return profile.select(
        *profile.columns,
        F.lit(None).cast("string").alias("failed_step"),
        F.lit(None).cast("string").alias("error_type"),
        F.lit(None).cast("string").alias("error"),
        F.array().cast("array<string>").alias("completed_steps"),
        F.lit(False).alias("validated"),
        F.lit(False).alias("converted"),
    )


def fail_first(files: DataFrame, step: str, failures: Iterable[tuple[Column, str, Column]]) -> DataFrame:
    """Apply one step: its first matching failure sticks, unless an earlier step failed."""
    failure = F.lit(None).cast("struct<type:string,text:string>")
    for condition, kind, text in reversed(list(failures)):
        failure = F.when(condition, F.struct(F.lit(kind).alias("type"), text.alias("text"))).otherwise(failure)
    running = F.col("failed_step").isNull()
    staged = files.withColumn("_f", F.when(running, failure))
    failed = F.col("_f").isNotNull()
    kept = [c for c in files.columns if c not in ("failed_step", "error_type", "error", "completed_steps")]
    return staged.select(
        *kept,
        F.when(failed, F.lit(step)).otherwise(F.col("failed_step")).alias("failed_step"),
        F.coalesce("_f.type", "error_type").alias("error_type"),
        F.coalesce("_f.text", "error").alias("error"),
        F.when(running & ~failed, F.concat("completed_steps", F.array(F.lit(step)))).otherwise(F.col("completed_steps")).alias("completed_steps"),
    )


def size_failure(max_bytes: int) -> tuple[Column, str, Column]:
    text = F.concat(F.lit("File is "), F.col("size_bytes").cast("string"), F.lit(f" bytes, max {max_bytes}"))
    return F.col("size_bytes") > max_bytes, "FileTooLarge", text


def content_failures(max_rows: int | None) -> list[tuple[Column, str, Column]]:
    """Fatal content errors in order; the row cap counts only where a cap is given."""
    failures = [(F.col("fatal_error").isNotNull(), "InvalidFile", F.col("fatal_error"))]
    if max_rows is not None:
        failures.append((F.col("total_rows") > max_rows, "InvalidFile", F.lit(f"Too many rows (max {max_rows})")))
    failures.append((F.col("total_rows") == 0, "InvalidFile", F.lit("File contains no data row")))
    return failures


def ratio_failure(max_invalid_ratio: float) -> tuple[Column, str, Column]:
    text = F.concat(
        F.col("invalid_rows").cast("string"),
        F.lit("/"),
        F.col("total_rows").cast("string"),
        F.lit(f" invalid rows (max ratio {plain_number(max_invalid_ratio)}): "),
        issue_text(F.coalesce("issues", F.array().cast("array<struct<line_number:int,message:string>>"))),
    )
    exceeded = (F.col("invalid_rows") > 0) & (F.try_divide("invalid_rows", "total_rows") > max_invalid_ratio)
    return exceeded, "InvalidRows", text


def empty_failure() -> tuple[Column, str, Column]:
    return F.col("valid_rows") == 0, "InvalidFile", F.lit("No valid measurement to store")


def with_status(files: DataFrame) -> DataFrame:
    """Stored or Invalid, with the counts the ledger keeps.

    Row counts appear only where validation passed.
    """
    stored = F.col("failed_step").isNull()
    counted = F.col("validated")
    return files.select(
        "file_key",
        *load_of(files),
        F.when(stored, "Stored").otherwise("Invalid").alias("status"),
        "size_bytes",
        "checksum",
        "format",
        F.when(counted, F.col("total_rows")).otherwise(0).cast("int").alias("row_count"),
        F.when(counted, F.col("invalid_rows")).otherwise(0).cast("int").alias("invalid_row_count"),
        F.when(stored, F.col("valid_rows")).otherwise(0).cast("int").alias("stored_count"),
        "failed_step",
        "error_type",
        "error",
        "completed_steps",
        "issues",
        "last_line",
    )
