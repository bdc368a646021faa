"""Reconciliation checks over the ledger, the measurements, the jobs and the objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_lines(measurements: DataFrame) -> DataFrame:
    """(file_key, line_number) stored more than once."""
    counts = measurements.groupBy("file_key", "line_number").agg(F.count(F.lit(1)).alias("copies"))
    return counts.where(F.col("copies") > 1)


def orphan_measurements(files: DataFrame, measurements: DataFrame) -> DataFrame:
    """Measurement counts of files whose ledger status is not Stored.

    Lines are counted per file before the join, so one large file does not skew it.
    """
    per_file = measurements.groupBy("file_key").agg(F.count(F.lit(1)).alias("measurements"))
    rejected = files.where(F.col("status") != "Stored").select(F.col("key").alias("file_key"), "status")
    return rejected.join(per_file, "file_key")


def _falsely_invalid() -> Column:
    return (F.col("status") == "Invalid") & ~F.col("key").like("%poison%") & ~F.col("error").like("Invalid%")


def false_invalid_files(files: DataFrame) -> DataFrame:
    """Rejected for a technical reason only: not marked poison, error not about the content."""
    return files.where(_falsely_invalid()).select("key", "error")


def _per_file(measurements: DataFrame) -> DataFrame:
    """Rows, uncategorized rows and duplicated line numbers of each file, in one pass."""
    per_line = measurements.groupBy("file_key", "line_number").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("category").isNull()).alias("_open")
    )
    return per_line.groupBy("file_key").agg(
        F.sum("_n").alias("rows"), F.sum("_open").alias("uncategorized"), F.count_if(F.col("_n") > 1).alias("duplicates")
    )


def _facts(frame: DataFrame, **columns: Column) -> DataFrame:
    """Aggregate to one row, then one (fact, amount) row per column."""
    row = frame.agg(*[column.cast("bigint").alias(name) for name, column in columns.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("fact"), F.col(name).alias("amount")) for name in columns])
    return row.select(F.inline(pairs))


def audit(
    files: DataFrame,
    measurements: DataFrame,
    jobs: DataFrame,
    objects: DataFrame,
    prefix: str,
    generated: int,
    expected_invalid: int,
    rows_per_file: int | None = None,
    staging: DataFrame | None = None,
) -> DataFrame:
    """The twelve end-to-end checks: name, observed, expected, ok.

    Every table is aggregated once to a handful of facts; the checks compare those.
    rows_per_file None leaves out the files-times-rows part of the row check.
    """
    mine = files.where(F.col("key").startswith(f"{prefix}/"))
    rows = measurements.where(F.col("file_key").startswith(f"{prefix}/"))
    status = lambda name: F.col("status") == name
    total = lambda amount: F.coalesce(F.sum(amount), F.lit(0))
    place = lambda *names: total(F.when(F.col("prefix").isin(*names), F.col("objects")))
    rejected = mine.where(~status("Stored")).select(F.col("key").alias("file_key"), F.lit(True).alias("_rejected"))
    poison = F.col("key").like("%poison%")
    parts = [
        _facts(objects, waiting=place("incoming/", "processing/"), processed=place("processed/"), invalid=place("invalid/")),
        _facts(
            mine,
            stored_files=F.count_if(status("Stored")),
            invalid_files=F.count_if(status("Invalid")),
            poison_not_invalid=F.count_if(poison & ~status("Invalid")),
            stored_rows=total(F.when(status("Stored"), F.col("stored_count"))),
            false_invalid=F.count_if(_falsely_invalid()),
        ),
        _facts(
            _per_file(rows).join(rejected, "file_key", "left"),
            rows=total(F.col("rows")),
            uncategorized=total(F.col("uncategorized")),
            duplicates=total(F.col("duplicates")),
            orphans=total(F.when(F.col("_rejected"), F.col("rows"))),
        ),
        _facts(jobs.where(F.col("job_id").startswith(prefix)), unfinished=F.count_if(F.col("status") != "Completed")),
    ]
    if staging is not None:
        parts.append(_facts(staging.where(F.col("job_id").startswith(prefix)), staged=F.count(F.lit(1))))
    facts = reduce(DataFrame.unionByName, parts)
    names = [
        "waiting", "processed", "invalid", "stored_files", "invalid_files", "poison_not_invalid", "stored_rows",
        "false_invalid", "rows", "uncategorized", "duplicates", "orphans", "unfinished", "staged",
    ]
    row = facts.agg(*[F.coalesce(F.max(F.when(F.col("fact") == n, F.col("amount"))), F.lit(0)).alias(n) for n in names])
    c = {n: F.col(n) for n in names}
    number = lambda n: F.lit(n).cast("bigint")
    wanted_rows = c["stored_rows"] if rows_per_file is None else c["stored_files"] * F.lit(rows_per_file)
    checks = [
        ("all files consumed", c["waiting"], number(0), None),
        ("processed and invalid files add up", c["processed"] + c["invalid"], number(generated), None),
        ("invalid files as expected", c["invalid"], number(expected_invalid), None),
        ("no file rejected for technical reasons only", c["false_invalid"], number(0), None),
        ("stored files match the objects", c["stored_files"], c["processed"], c["invalid_files"] == c["invalid"]),
        ("every poison file rejected", c["poison_not_invalid"], number(0), None),
        ("measurements match the stored rows", c["rows"], c["stored_rows"], c["rows"] == wanted_rows),
        ("no duplicated measurement", c["duplicates"], number(0), None),
        ("no measurement of a rejected file", c["orphans"], number(0), None),
        ("every measurement categorized", c["uncategorized"], number(0), None),
        ("all processing jobs completed", c["unfinished"], number(0), None),
        ("staging empty", c["staged"], number(0), None),
    ]
    structs = [
        F.struct(
            F.lit(name).alias("name"),
            seen.alias("observed"),
            want.alias("expected"),
            ((seen == want) & (also if also is not None else F.lit(True))).alias("ok"),
        )
        for name, seen, want, also in checks
    ]
    return row.select(F.inline(F.array(*structs)))
