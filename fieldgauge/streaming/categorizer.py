"""Incremental categorization: follows the ledger and processes each new load."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import LEDGER_SCHEMA, SensorStore
from ..plans.process import categorize_loads
from ..plans.steps import SENSOR_PROCESSING, Definition
from .inbox import trigger_of


def categorize_stream(
    spark: SparkSession,
    store_root: str,
    checkpoint: str,
    definition: Definition | Callable[[], Definition] = SENSOR_PROCESSING,
    batch_size: int = 500,
    interval_seconds: int | None = None,
    as_of: datetime | None = None,
    max_loads: int = 100,
) -> StreamingQuery:
    """Start categorizing what is committed to a store.

    New ledger files say which loads are new; only those loads are read. Micro-batches
    never overlap, so jobs neither. A repeated micro-batch finds its loads done.
    """
    store = SensorStore(spark, store_root)
    ledger = spark.readStream.schema(LEDGER_SCHEMA).parquet(store.path("ledger"))

    def process_batch(events: DataFrame, batch_id: int) -> None:
        newest = events.agg(F.max("load")).first()[0]
        # A backlog is taken in jobs of max_loads; the definition is asked again for each.
        while newest is not None:
            current = definition() if callable(definition) else definition
            if categorize_loads(store, None, current, batch_size, as_of, newest, max_loads) is None:
                break

    return (
        ledger.select("load")
        .writeStream.foreachBatch(process_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_of(interval_seconds))
        .start()
    )
