"""Long groups of ordered rows without a task or a list of their own: global places, numbers within a group, digests of a group.

Rows are dealt by range of (group, order), so one group may span many tasks; what the tasks hold of it is put together
from one small record per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

# A place is the number of a task, then the number of a row in it, as Spark's increasing ids have it.
PART_BITS = 33
# Digests of a group that spans tasks are fed from blocks of about so many bytes.
BLOCK_BYTES = 1 << 16


def group_key(identifier: Column) -> Column:
    """A string without nulls for an id of any type; a null id is a group of its own."""
    return F.when(identifier.isNull(), "n").otherwise(F.concat(F.lit("v"), identifier.cast("string")))


def group_id(key: Column, data_type) -> Column:
    """The id a `group_key` was made of."""
    return F.when(key != "n", F.substring(key, 2, 1 << 30)).cast(data_type)


def placed(rows: DataFrame, order: list[Column], path: str) -> DataFrame:
    """The rows as a table with `place`, a number that grows with (key, order). Equal rows are told apart by their number
    in the input, so that many of them are no single range."""
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("key", *order, "place").sortWithinPartitions("key", *order, "place")
    return written(ranged.withColumn("place", F.monotonically_increasing_id()), path)


def numbered(table: DataFrame, per_key: DataFrame | None = None) -> DataFrame:
    """`index`, the number of a row within its key from 0, for a `placed` table: its place in its task's share of the key
    plus the sizes of the earlier shares. `per_key` gives every row its key's columns by the same join, which is on shares, not keys."""
    part = F.shiftright("place", PART_BITS)
    shares = table.groupBy("key", part.alias("part")).agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("key", "part", (before - F.col("begin")).alias("shift"))
    if per_key is not None:
        shares = shares.join(per_key, "key")
    return table.withColumn("part", part).join(shares, ["key", "part"]).withColumn("index", F.col("place") + F.col("shift")).drop("part", "shift")


def column_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Key and bytes of rows that hold them as columns `key` and `piece`."""
    for batch in batches:
        yield from zip(batch.column("key").to_pylist(), (p if isinstance(p, bytes) else p.encode() for p in batch.column("piece").to_pylist()))


def run_digests(rows: DataFrame, order: list[str], folder: str, pieces: Callable = column_pieces, joiner: bytes = b"", dealt_by: int | None = None) -> DataFrame:
    """(key, sha256) over each key's pieces in order, `joiner` between them.

    `pieces` turns a task's sorted batches into (key, bytes); keys without a piece have no row. A key that lies within one task is
    digested there. What a task has of its first and last key, or of one beyond a block, is written as blocks, and the blocks of a key are
    read in order: nothing holds more than a block. The digest itself is one sequence by its nature. The first `dealt_by` columns of
    `order` (all by default) deal out the rows; rows equal in them stay in one task.
    """

    def by_task(batches):
        part, counter = TaskContext.get().partitionId(), 0
        out: list[tuple] = []
        key = held = None
        size, whole = 0, False

        def block():
            nonlocal counter, held, size
            out.append((key, None, (part << PART_BITS) + counter, joiner.join(held)))
            counter, held, size = counter + 1, [], 0

        for now, piece in pieces(batches):
            if now != key:
                if key is not None:
                    if whole:
                        out.append((key, hashlib.sha256(joiner.join(held)).hexdigest(), None, None))
                    elif held:
                        block()
                whole, key, held, size = key is not None, now, [], 0
            held.append(piece)
            size += len(piece)
            if size >= BLOCK_BYTES:
                whole = False
                block()
            if len(out) >= 256:
                yield _batch(out)
                out = []
        if held:
            block()
        if out:
            yield _batch(out)

    def joined(batches):
        key, state = None, None
        out = []
        for batch in batches:
            for now, block in zip(batch.column("key").to_pylist(), batch.column("block")):
                if now != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                else:
                    state.update(joiner)
                state.update(block.as_buffer())
            yield pa.RecordBatch.from_pylist([{"key": k, "sha256": d} for k, d in out], pa.schema([("key", pa.string()), ("sha256", pa.string())]))
            out = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "sha256": state.hexdigest()}], pa.schema([("key", pa.string()), ("sha256", pa.string())]))

    ranged = rows.repartitionByRange("key", *order[:dealt_by]).sortWithinPartitions("key", *order)
    found = written(ranged.mapInArrow(by_task, "key string, sha256 string, seq long, block binary"), folder)
    spread = found.where("block is not null").select("key", "seq", "block").repartition("key").sortWithinPartitions("key", "seq")
    return found.where("sha256 is not null").select("key", "sha256").unionByName(spread.mapInArrow(joined, "key string, sha256 string"))


_BLOCKS = pa.schema([("key", pa.string()), ("sha256", pa.string()), ("seq", pa.int64()), ("block", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)
