"""Batches: consecutive runs of a type's measurements in id order.

A plain row number over five types would sort a type in one task. Ids are unique, so a
slice of the id axis holds a bounded number of rows. Rows are numbered inside slices of
2^20 ids, and the slices' counts are added up over two levels: no window group ever holds
more than 2^20 rows or 2^22 slice counts, whatever the data and however skewed the types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 20
BLOCK_BITS = 42
BATCH_SIZE_RANGE = (1, 10_000)


def check_batch_size(size: int) -> int:
    low, high = BATCH_SIZE_RANGE
    if not low <= size <= high:
        raise ValueError(f"Batch size must be in [{low}, {high}]")
    return size


def uncategorized(job: Column | None) -> Column:
    """Never categorized, or categorized by this very job in an earlier attempt."""
    condition = F.col("category").isNull()
    return condition if job is None else condition | F.coalesce(F.col("categorized_by_job") == job, F.lit(False))


def eligible(
    measurements: DataFrame,
    after_id: int | None = None,
    only_uncategorized: bool = True,
    job: Column | None = None,
    sensor_types: Sequence[str] | None = None,
    first_id: int | None = None,
    last_id: int | None = None,
) -> DataFrame:
    """Type, cursor, id-range and only-uncategorized filters; all of them reach the scan."""
    rows = measurements
    if sensor_types is not None:
        rows = rows.where(F.col("sensor_type").isin(list(sensor_types)))
    if after_id is not None:
        rows = rows.where(F.col("id") > after_id)
    if first_id is not None:
        rows = rows.where(F.col("id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("id") <= last_id)
    if only_uncategorized and "category" in rows.columns:
        rows = rows.where(uncategorized(job))
    return rows


def fetch_page(measurements: DataFrame, sensor_type: str, after_id: int, size: int) -> DataFrame:
    """One keyset page of ids: a distributed top-k."""
    page = eligible(measurements, after_id, False, sensor_types=[sensor_type]).select("id")
    return page.orderBy("id").limit(check_batch_size(size))


def with_row_number(rows: DataFrame, group: str = "sensor_type", order: str = "id", slice_bits: int = SLICE_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """row_number() over (partition by group order by order), for unique integer order keys."""
    slice_of = F.shiftright(F.col(order), slice_bits)
    counts = (
        rows.select(group, slice_of.alias("_slice"))
        .groupBy(group, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_block", F.shiftright("_slice", block_bits - slice_bits))
    )
    within_block = Window.partitionBy(group, "_block").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    within_group = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(group, "_block").agg(F.sum("_n").alias("_block_n"))
    block_offsets = blocks.withColumn("_block_offset", F.coalesce(F.sum("_block_n").over(within_group), F.lit(0)))
    offsets = (
        counts.withColumn("_slice_offset", F.coalesce(F.sum("_n").over(within_block), F.lit(0)))
        .join(block_offsets.drop("_block_n"), [group, "_block"])
        .select(group, "_slice", (F.col("_slice_offset") + F.col("_block_offset")).alias("_offset"))
    )
    local = Window.partitionBy(group, "_slice").orderBy(order)
    numbered = rows.withColumn("_slice", slice_of).withColumn("_local", F.row_number().over(local))
    # No broadcast hint: the number of slices grows with the data, Spark goes by its size.
    return numbered.join(offsets, [group, "_slice"]).select(
        *[F.col(c) for c in rows.columns], (F.col("_local") + F.col("_offset")).cast("bigint").alias("row_number")
    )


def batch_number(row_number: Column, sizes: Sequence[tuple[int, int]]) -> Column:
    """Batch of a row for a size schedule of (first batch, size) pairs in ascending order."""
    steps = sorted(sizes)
    if not steps or steps[0][0] != 1:
        raise ValueError("the first size applies from batch 1")
    result, rows_before, bounds = None, 0, []
    for index, (first, size) in enumerate(steps):
        check_batch_size(size)
        last_row = None
        if index + 1 < len(steps):
            last_row = rows_before + (steps[index + 1][0] - first) * size
        bounds.append((rows_before, last_row, first, size))
        rows_before = last_row if last_row is not None else rows_before
    for before, last_row, first, size in reversed(bounds):
        number = F.lit(first) + F.floor((row_number - 1 - before) / F.lit(size))
        result = number if last_row is None else F.when(row_number <= last_row, number).otherwise(result)
    return result.cast("int")


def assign_batches(
    measurements: DataFrame,
    batch_size: int | Sequence[tuple[int, int]] = 500,
    max_batches: int = 0,
    after_id: int | None = None,
    job: Column | None = None,
    only_uncategorized: bool = True,
    sensor_types: Sequence[str] | None = None,
) -> DataFrame:
    """Eligible measurements with row_number and batch_number; max_batches 0 means all."""
    sizes = [(1, batch_size)] if isinstance(batch_size, int) else list(batch_size)
    rows = eligible(measurements, after_id, only_uncategorized, job, sensor_types)
    numbered = with_row_number(rows)
    batched = numbered.withColumn("batch_number", batch_number(F.col("row_number"), sizes))
    return batched.where(F.col("batch_number") <= max_batches) if max_batches > 0 else batched


def batch_ranges(batched: DataFrame, failed: Column | None = None) -> DataFrame:
    """First id, last id and count of each batch, and the rows processed once it is done; with `failed`, a condition on rows, also
    whether it holds for any.

    The last row's number is that running total, so no batch has to look at earlier ones.
    """
    return batched.groupBy("sensor_type", "batch_number").agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count(F.lit(1)).alias("count"),
        F.max("row_number").alias("processed"),
        *([F.coalesce(F.bool_or(failed), F.lit(False)).alias("failed")] if failed is not None else []),
    )
