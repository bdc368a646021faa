"""Processing: categorize measurements in batches and aggregate them per sensor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.catalog import type_names
from ..functions.text import job_key
from ..operators.batches import assign_batches
from ..operators.results import check_types, failed_batch_sizes
from ..operators.store import SensorStore, folder_value
from .steps import SENSOR_PROCESSING, Definition, StepContext, StepFailed, StepRun, run_steps


# Error texts are kept to the length the ledger keeps.
ERROR_CHARS = 2000


@dataclass
class JobPlan:
    """Frames of one job over all its sensor types."""

    batched: DataFrame
    run: StepRun


def plan_job(
    measurements: DataFrame,
    base: Column | str,
    definition: Definition = SENSOR_PROCESSING,
    batch_size: int | Sequence[tuple[int, int]] = 500,
    as_of: Column | None = None,
    max_batches: int = 0,
    only_uncategorized: bool = True,
    sensor_types: Sequence[str] | None = None,
    earlier_batches: dict[str, int] | None = None,
    keep: list[DataFrame] | None = None,
) -> JobPlan:
    """One plan for every type at once: job ids are base-type.

    Asked types must be in the catalog, else the whole request is refused. `earlier_batches` says how many batches each type has had;
    numbers go on from there. The batched rows are cached and put into `keep` where it is given.
    """
    if sensor_types is not None:
        check_types(list(sensor_types))
    job = job_key(base, F.col("sensor_type"))
    batched = assign_batches(measurements, batch_size, max_batches, None, job, only_uncategorized, sensor_types)
    if earlier_batches:
        before = F.create_map(*[F.lit(x) for pair in sorted(earlier_batches.items()) for x in pair])
        batched = batched.withColumn("batch_number", (F.col("batch_number") + F.coalesce(F.try_element_at(before, F.col("sensor_type")), F.lit(0))).cast("int"))
    if keep is not None:
        batched = batched.persist(StorageLevel.MEMORY_AND_DISK)
        keep.append(batched)
    context = StepContext(job=job, as_of=as_of)
    return JobPlan(batched, run_steps(batched, definition, context))


@dataclass
class _Totals:
    """What a job has done so far with one type."""

    processed: int = 0
    batches: int = 0
    failed: int = 0


class _Job:
    """One job over a span of loads, in steps of some loads each, with its rows in the store."""

    def __init__(self, store: SensorStore, base: str, first: int, last: int, definition: Definition, now: Column):
        self.store, self.base, self.first, self.last = store, base, first, last
        self.definition, self.now, self.span = definition, now, f"{first + 1}-{last}"
        self.totals = {name: _Totals() for name in type_names()}

    def resume(self) -> tuple[int, int]:
        """Go on behind the last step that an earlier run of this job finished: its number, and the load it reached."""
        done = self.store.progress(self.base, self.span)
        last = done.agg(F.max(F.struct("step", "to_load")).alias("last")).first()["last"]
        if last is None:
            return 0, self.first
        for row in done.where(F.col("step") == last["step"]).collect():
            self.totals[row["sensor_type"]] = _Totals(row["processed"], row["batches"], row["failed_batches"])
        return last["step"], last["to_load"]

    def rows(self, status: str, reached: int, error: str | None = None, types: list[str] | None = None) -> DataFrame:
        """A row per type: at most as many as the catalog has types."""
        spark = self.store.spark
        counted = [(name, t.processed, t.batches, t.failed) for name, t in sorted(self.totals.items()) if types is None or name in types]
        # One task is enough for them.
        frame = spark.createDataFrame(counted, "sensor_type string, processed bigint, batches bigint, failed_batches bigint").coalesce(1)
        return frame.select(
            job_key(self.base, F.col("sensor_type")).alias("job_id"),
            "sensor_type",
            F.lit(status).alias("status"),
            F.lit(self.definition.name).alias("pipeline"),
            F.lit(self.definition.version).cast("int").alias("pipeline_version"),
            "processed",
            "batches",
            "failed_batches",
            F.lit(error).cast("string").alias("error"),
            F.lit(self.first).cast("bigint").alias("from_load"),
            F.lit(reached).cast("bigint").alias("to_load"),
            self.now.alias("started_at"),
            self.now.alias("updated_at"),
            (self.now if status != "Running" else F.lit(None).cast("timestamp")).alias("completed_at"),
        )

    def record(self, step: int, reached: int) -> None:
        """A Running row per type: what is done after a step."""
        self.store.write_job("progress", self.base, self.span, self.rows("Running", reached), step=step)

    def finish(self, status: str, error: str | None = None, types: list[str] | None = None) -> None:
        self.store.write_job("jobs", self.base, self.span, self.rows(status, self.last, error, types))

    def run_step(self, step: int, measurements: DataFrame, batch_size: int, reached: int) -> None:
        """Categorize one step's rows and write what comes of them, then its progress.

        Rows and batches are counted by an observation of the write itself, not by another pass.
        """
        kept: list[DataFrame] = []
        try:
            earlier = {name: t.batches for name, t in self.totals.items()}
            plan = plan_job(measurements, self.base, self.definition, batch_size, self.now, earlier_batches=earlier, keep=kept)
            run, store = plan.run, self.store
            if run.fatal is not None and (wrong := run.fatal.orderBy("sensor_type", "batch_number").first()) is not None:
                raise StepFailed(f"Step {wrong['failed_step']} failed on batch {wrong['batch_number']}: {wrong['error']}")
            failed: dict[str, tuple[int, int, int]] = {}
            if run.failed is not None:
                failures = failed_batch_sizes(plan.batched, run.failed)
                failures = failures.select(job_key(self.base, F.col("sensor_type")).alias("job_id"), "sensor_type", "batch_number", "failed_step", "error", "rows")
                store.write_job("failures", self.base, self.span, failures, step=step)
                written = store._read("failures", "sensor_type STRING, batch_number INT, rows BIGINT", f"job_base={folder_value(self.base)}/span={self.span}/step={step}")
                per_type = written.groupBy("sensor_type").agg(F.count_distinct("batch_number").alias("n"), F.max("batch_number").alias("last"), F.sum("rows").alias("rows"))
                failed = {r["sensor_type"]: (r["n"], r["last"], r["rows"]) for r in per_type.collect()}
            seen = Observation(f"step-{step}")
            names = sorted(self.totals)
            of_type = lambda name: F.col("sensor_type") == name
            metrics = [F.count_if(of_type(n)).alias(f"rows {n}") for n in names] + [F.max(F.when(of_type(n), F.col("batch_number"))).alias(f"last {n}") for n in names]
            observed = run.rows.observe(seen, *metrics)
            if run.updates and "category" in run.rows.columns:
                store.write_job("categorized", self.base, self.span, observed.drop("row_number"), ("sensor_type",), step)
            else:
                observed.select("sensor_type").write.format("noop").mode("overwrite").save()
            if run.results is not None:
                results = run.results.select(job_key(self.base, F.col("sensor_type")).alias("job_id"), "*", self.now.alias("created_at"))
                store.write_job("results", self.base, self.span, results, step=step)
            counted = seen.get
            for name, total in self.totals.items():
                n, last_failed, rows = failed.get(name, (0, 0, 0))
                total.processed += counted[f"rows {name}"] + rows
                total.batches = max(total.batches, counted[f"last {name}"] or 0, last_failed)
                # A step that could not be planned failed in every batch.
                total.failed += total.batches - earlier[name] if run.failed_steps else n
            self.record(step, reached)
        finally:
            for frame in kept:
                frame.unpersist()


def categorize_loads(
    store: SensorStore,
    base: str | None = None,
    definition: Definition = SENSOR_PROCESSING,
    batch_size: int = 500,
    as_of: datetime | None = None,
    upto: int | None = None,
    max_loads: int = 0,
    loads_per_step: int = 0,
    max_steps: int = 0,
) -> str | None:
    """Categorize the loads committed since the last completed job, at most max_loads of them.

    Only new loads are read and only new folders written, named by base and span of loads: a base can be used again without touching
    its earlier rows. A job goes over its loads in steps of `loads_per_step` (0: all at once); each leaves a Running row per
    type with what is done so far, and a job that was cut short goes on behind its last finished step. A step ends its last batch
    early. `max_steps` leaves the job running after so many steps.

    The job rows are written last: they make the job's categories and results visible. A batch in which a step fails that may be skipped
    fails alone: its rows get no category and no result, and `failures` has its error. Any other error leaves Failed rows, and the
    loads stay open for the next job. Late rows belong to a later load, and so to the next job.
    """
    first, last = store.last_categorized_load(), store.last_load() if upto is None else upto
    if last <= first:
        return None
    if max_loads > 0:
        last = min(last, first + max_loads)
    job = _Job(store, base or f"job-{first + 1}-{last}", first, last, definition, F.lit(as_of or datetime.now(timezone.utc)))
    step, reached = job.resume()
    if step == 0 and reached == first:
        job.record(0, first)
    try:
        steps = 0
        while reached < last and not 0 < max_steps <= steps:
            upper = min(last, reached + loads_per_step) if loads_per_step > 0 else last
            step, steps = step + 1, steps + 1
            job.run_step(step, store.measurements(reached, upper), batch_size, upper)
            reached = upper
    except Exception as failure:
        types = [r["sensor_type"] for r in store.measurements(first, last).select("sensor_type").distinct().collect()]
        job.finish("Failed", str(failure)[:ERROR_CHARS], types)
        raise
    if reached == last:
        job.finish("Completed", None, [name for name, total in job.totals.items() if total.processed])
    return job.base


def categorize_missed(store: SensorStore, base: str, definition: Definition = SENSOR_PROCESSING, batch_size: int = 500, as_of: datetime | None = None) -> str:
    """Categorize what earlier jobs left without a category, as the rows of failed batches."""
    last = store.last_categorized_load()
    job = _Job(store, base, last, last, definition, F.lit(as_of or datetime.now(timezone.utc)))
    job.span = f"missed-{last}"
    job.run_step(1, store.uncategorized(), batch_size, last)
    job.finish("Completed", None, [name for name, total in job.totals.items() if total.processed])
    return base
