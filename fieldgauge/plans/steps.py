"""Step lists: named, versioned lists of DataFrame transforms with parameters.

A definition lives in a versioned table as JSON. Its steps run in order over the whole
table: ingestion steps over one row per file, processing steps over measurements.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import definition_kind
from ..operators import verdicts
from ..operators.results import check_thresholds, failed_batches, per_sensor_results, stamp, try_categorize
from ..operators.versions import append_version, get_version
from ..sources.drop_files import MAX_BYTES

# The steps each kind of definition may use.
STEP_NAMES = {
    "ingestion": ["ingest.fetch", "ingest.validate", "ingest.convert", "ingest.store"],
    "processing": [
        "processing.categorize",
        "processing.update-measurements",
        "processing.insert-results",
        "processing.cleanup",
    ],
}

STEP_DDL = (
    "STRUCT<activity: STRING, enabled: BOOLEAN, maxAttempts: INT, initialRetrySeconds: INT, maxRetrySeconds: INT, "
    "timeoutSeconds: INT, heartbeatTimeoutSeconds: INT, continueOnError: BOOLEAN, parameters: MAP<STRING, STRING>>"
)
DEFINITION_DDL = f"name STRING, version INT, comment STRING, steps ARRAY<{STEP_DDL}>"


@dataclass(frozen=True)
class Step:
    activity: str
    enabled: bool = True
    max_attempts: int = 10
    initial_retry_seconds: int = 1
    max_retry_seconds: int = 30
    timeout_seconds: int = 120
    heartbeat_timeout_seconds: int = 20
    continue_on_error: bool = False
    parameters: dict[str, str] = field(default_factory=dict)

    def number(self, name: str, fallback: float, kind: type = int) -> float:
        """A numeric parameter; missing or unreadable gives the fallback."""
        try:
            return kind(self.parameters[name])
        except (KeyError, ValueError):
            return fallback


@dataclass(frozen=True)
class Definition:
    name: str
    steps: tuple[Step, ...]
    version: int = 1
    comment: str | None = None

    @property
    def enabled_steps(self) -> list[Step]:
        return [s for s in self.steps if s.enabled]

    def step(self, activity: str) -> Step | None:
        """The enabled step of that name."""
        return next((s for s in self.enabled_steps if s.activity == activity), None)


# The default definitions.
FILE_INGESTION = Definition(
    "file-ingestion",
    (
        Step("ingest.fetch"),
        Step("ingest.validate", parameters={"maxInvalidRowRatio": "0.0", "maxRows": "100000"}),
        Step("ingest.convert", max_attempts=6),
        Step("ingest.store", timeout_seconds=300),
    ),
    comment="Read, check, normalize and store drop files",
)
SENSOR_PROCESSING = Definition(
    "sensor-processing",
    (
        Step("processing.categorize", parameters={"thresholds.temperature": "5;30;45", "thresholds.humidity": "20;70;90"}),
        Step("processing.update-measurements"),
        Step("processing.insert-results"),
        Step("processing.cleanup", max_attempts=0, continue_on_error=True),
    ),
    comment="Give measurements a category and sum them up per sensor",
)


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.title() for part in tail)


def to_json(definition: Definition) -> str:
    names = ["activity", *[f for f in Step.__dataclass_fields__ if f != "activity"]]
    steps = [{_camel(n): getattr(s, n) for n in names} for s in definition.steps]
    return json.dumps({"name": definition.name, "version": definition.version, "comment": definition.comment, "steps": steps})


def from_json(text: str) -> Definition:
    document = json.loads(text)
    known = {_camel(n): n for n in Step.__dataclass_fields__}
    steps = tuple(Step(**{known[k]: v for k, v in s.items() if k in known and v is not None}) for s in document["steps"])
    return Definition(document["name"], steps, document.get("version") or 1, document.get("comment"))


def load_definition(definitions: DataFrame, name: str, version: int | None = None) -> Definition:
    """Newest or exact version out of a (name, version, definition_json) table: one row."""
    row = get_version(definitions, name, version).select("version", "definition_json").first()
    if row is None:
        raise LookupError(f"Unknown definition '{name}'" + (f" v{version}" if version is not None else ""))
    return replace(from_json(row["definition_json"]), name=name, version=row["version"])


def save_definition(definitions: DataFrame, definition: Definition, as_of: Column) -> DataFrame:
    """The row to append for a new version of a definition; earlier versions stay."""
    spark = definitions.sparkSession
    new = spark.createDataFrame([(definition.name, to_json(definition), definition.comment)], "name STRING, definition_json STRING, comment STRING")
    saved = append_version(definitions.where(F.col("name") == definition.name), new.withColumn("created_at", as_of))
    return saved.select("name", F.col("version").cast("int").alias("version"), "definition_json", "comment", "created_at")


def reset_definition(definitions: DataFrame, name: str, as_of: Column) -> DataFrame:
    """The default of that name, saved as a new version."""
    default = next((d for d in (FILE_INGESTION, SENSOR_PROCESSING) if d.name == name), None)
    if default is None:
        raise LookupError(f"No default definition '{name}'")
    return save_definition(definitions, default, as_of)


def decode_definitions(table: DataFrame) -> DataFrame:
    """(name, version, steps) from the JSON column; the table's name and version hold."""
    parsed = F.from_json("definition_json", DEFINITION_DDL)
    return table.select("name", "version", parsed["steps"].alias("steps"))


def encode_definitions(definitions: DataFrame) -> DataFrame:
    """(name, version, definition_json) from (name, version, comment, steps)."""
    return definitions.select("name", "version", F.to_json(F.struct("name", "version", "comment", "steps")).alias("definition_json"))


def enabled_steps(steps: Column) -> Column:
    return F.filter(steps, lambda s: F.coalesce(s["enabled"], F.lit(True)))


def definition_errors(definitions: DataFrame) -> DataFrame:
    """Every error of every definition in (name, version, steps)."""
    kind = definition_kind(F.col("name"))
    allowed_names = lambda k: F.array(*map(F.lit, STEP_NAMES[k]))
    staged = definitions.select(
        "name",
        "version",
        F.when(kind == "processing", allowed_names("processing")).otherwise(allowed_names("ingestion")).alias("_allowed"),
        F.posexplode_outer("steps").alias("position", "_step"),
    )
    step = F.col("_step")
    activity = F.coalesce(step["activity"], F.lit(""))
    bad_number = (
        (F.coalesce(step["maxAttempts"], F.lit(10)) < 0)
        | (F.coalesce(step["timeoutSeconds"], F.lit(120)) <= 0)
        | (F.coalesce(step["heartbeatTimeoutSeconds"], F.lit(20)) < 0)
    )
    # The three error texts.
    found = F.array(
        F.when(F.col("position").isNull(), F.lit("A pipeline needs at least one step")),
        F.when(
            F.col("position").isNotNull() & ~F.array_contains("_allowed", activity),
            F.concat(F.lit("Unknown step '"), activity, F.lit("'. Allowed: "), F.array_join("_allowed", ", ")),
        ),
        F.when(F.col("position").isNotNull() & bad_number, F.concat(F.lit("Step '"), activity, F.lit("': invalid retry/timeout values"))),
    )
    return staged.select("name", "version", "position", F.explode(F.array_compact(found)).alias("error"))


class StepFailed(RuntimeError):
    """A step failed and its definition does not let the job go on."""


@dataclass
class StepRun:
    """What a run of steps produced.

    `failed` are batches (sensor_type, batch_number, failed_step, error) in which a step failed that may be skipped; their rows are
    no longer in `rows`. `fatal` are such batches of steps that may not be skipped.
    """

    rows: DataFrame
    results: DataFrame | None = None
    failed_steps: list[str] = field(default_factory=list)
    updates: bool = False
    completed: list[str] = field(default_factory=list)
    failed: DataFrame | None = None
    fatal: DataFrame | None = None

    def fold_errors(self, rows: DataFrame, step: Step) -> None:
        """Take rows with step_error: a batch fails as a whole when one of its rows does, and fails alone."""
        failed = failed_batches(rows, step.activity)
        if not step.continue_on_error:
            self.fatal = failed if self.fatal is None else self.fatal.unionByName(failed)
            self.rows = rows.drop("step_error")
            return
        self.failed = failed if self.failed is None else self.failed.unionByName(failed)
        # Spark broadcasts the failed batches by their size; without any, adaptive execution drops the join.
        self.rows = rows.drop("step_error").join(failed.select("sensor_type", "batch_number"), ["sensor_type", "batch_number"], "left_anti").select(*[c for c in rows.columns if c != "step_error"])


@dataclass(frozen=True)
class StepContext:
    job: Column | None = None
    as_of: Column | None = None
    result_keys: tuple[str, ...] = ("sensor_type", "batch_number", "sensor_id")


StepFunction = Callable[[StepRun, Step, StepContext], None]


def _fetch(run: StepRun, step: Step, _: StepContext) -> None:
    run.rows = verdicts.fail_first(run.rows, step.activity, [verdicts.size_failure(int(step.number("maxBytes", MAX_BYTES)))])


def _validate(run: StepRun, step: Step, _: StepContext) -> None:
    failures = verdicts.content_failures(int(step.number("maxRows", 100_000)))
    failures.append(verdicts.ratio_failure(step.number("maxInvalidRowRatio", 0.0, float)))
    checked = verdicts.fail_first(run.rows, step.activity, failures)
    run.rows = checked.withColumn("validated", F.col("failed_step").isNull())


def _convert(run: StepRun, step: Step, _: StepContext) -> None:
    checked = verdicts.fail_first(run.rows, step.activity, verdicts.content_failures(None))
    run.rows = checked.withColumn("converted", F.col("failed_step").isNull())


def _store(run: StepRun, step: Step, _: StepContext) -> None:
    run.rows = verdicts.fail_first(run.rows, step.activity, [verdicts.empty_failure()])


def _categorize(run: StepRun, step: Step, _: StepContext) -> None:
    if "batch_number" not in run.rows.columns:
        # No batch can fail alone, so thresholds that cannot be read fail the step.
        check_thresholds(step.parameters)
    run.fold_errors(try_categorize(run.rows, step.parameters), step)


def _update(run: StepRun, _: Step, context: StepContext) -> None:
    if context.job is not None and context.as_of is not None:
        run.rows = stamp(run.rows, context.job, context.as_of)
    run.updates = True


def _results(run: StepRun, _: Step, context: StepContext) -> None:
    run.results = per_sensor_results(run.rows, context.result_keys)


def _cleanup(run: StepRun, _: Step, __: StepContext) -> None:
    """Nothing is staged in a table, so nothing is left to clean."""


STEPS: dict[str, StepFunction] = {
    "ingest.fetch": _fetch,
    "ingest.validate": _validate,
    "ingest.convert": _convert,
    "ingest.store": _store,
    "processing.categorize": _categorize,
    "processing.update-measurements": _update,
    "processing.insert-results": _results,
    "processing.cleanup": _cleanup,
}


def run_steps(rows: DataFrame, definition: Definition, context: StepContext | None = None, steps: dict[str, StepFunction] | None = None) -> StepRun:
    """Run the enabled steps in order. A step whose plan cannot be built ends the run unless it may be skipped; what goes wrong in
    the rows becomes failed batches."""
    run, context, functions = StepRun(rows), context or StepContext(), steps or STEPS
    for step in definition.enabled_steps:
        try:
            functions[step.activity](run, step, context)
            run.completed.append(step.activity)
        except Exception as cause:
            if not step.continue_on_error:
                raise StepFailed(f"Step {step.activity} failed: {type(cause).__name__}: {cause}") from cause
            run.failed_steps.append(step.activity)
    return run
