"""Intermediate tables in the shared folder, and connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .shipping import ship


def workspace(frame: DataFrame, label: str) -> str:
    """A fresh folder for one operator's tables; the operator's modules are sent to the executors."""
    ship(frame.sparkSession)
    return scratch_path(frame.sparkSession, label)


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame as a table in the shared folder: later jobs read it, and lost executors cost no recomputation."""
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def connected(links: DataFrame, folder: str) -> DataFrame:
    """(node, class_id) of every linked node by alternating large-star and small-star rounds.

    Each round is a minimum per node (combined before the shuffle) joined back to the links; rounds grow with
    the logarithm of the longest chain. Stops when a round changes nothing.
    """
    step = 0
    links = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("class_id")).distinct()
    links = written(links, f"{folder}/0")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("class_id").alias("node"), F.col("node").alias("class_id")))
        least = both.groupBy("node").agg(F.least(F.min("class_id"), F.col("node")).alias("least"))
        large = both.where("class_id > node").join(least, "node").select(F.col("class_id").alias("node"), F.col("least").alias("class_id"))
        large = large.where("node <> class_id").distinct()
        least = large.groupBy("node").agg(F.min("class_id").alias("least"))
        kept = least.select("node", F.col("least").alias("class_id"))
        small = large.join(least, "node").where("class_id <> least").select(F.col("class_id").alias("node"), F.col("least").alias("class_id"))
        step += 1
        links = written(kept.unionByName(small).distinct(), f"{folder}/{step}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("node", "class_id").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    tops = links.select(F.col("class_id").alias("node"), "class_id")
    return links.unionByName(tops).distinct()
