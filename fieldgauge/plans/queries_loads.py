"""Registered queries over the life of a load: claims, lost files, sweeps, conversion, running and partly failed jobs, compaction."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import job_key
from ..operators.dispatch import scan_totals
from ..operators.ledger import ledger_events
from ..operators.results import failed_batch_sizes
from ..operators.store import LateWriter, SensorStore
from ..session import scratch_path
from ..sources.normalized import read_normalized
from ..streaming.inbox import ingest_stream
from . import standins
from .ingest import folder_files, ingest_folder, ingest_load, named_files, plan_load, with_ids
from .process import categorize_loads, plan_job
from .queries_ingest import FULL, STORED, _readings
from .queries_process import BASE, BATCH, STEP_LIST, THRESHOLDS
from .queries_streams import AS_OF, CATEGORY, drop_folder, folder_key
from .steps import Definition, Step

# -- Spark --------------------------------------------------------------------------------


def _store(spark: SparkSession) -> SensorStore:
    return SensorStore(spark, scratch_path(spark, "store"))


def _live_rows(store: SensorStore) -> DataFrame:
    """Current row per file with the number of its live measurements."""
    rows = store.measurements().groupBy(F.col("file_key").alias("key")).agg(F.count("*").alias("live_rows"))
    return store.files().join(rows, "key", "left").withColumn("live_rows", F.coalesce("live_rows", F.lit(0)))


def claimed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after three loads: all of them; the CSV files, whose first writer is given up, replaced and comes back late; the JSON
    files, whose writer dies after the claim."""
    store, inbox = _store(spark), drop_folder(spark, sf_dir)
    ingest_folder(store, inbox, "first", as_of=AS_OF, key_of=folder_key)
    files = folder_files(spark, inbox, folder_key)
    csv, json = (files.where(F.col("file_key").endswith(end)) for end in (".csv", ".json"))
    claim = lambda source, some: store.claim(source, some.select(F.col("file_key").alias("key"), "path"), F.lit(AS_OF))
    late = claim("second", csv)
    plan = plan_load(csv.drop("path"), F.lit(AS_OF))
    # What the late writer read differs, so that its rows would show.
    readings, last_id = with_ids(plan.readings.withColumn("value", -F.col("value")).where("line_number % 2 = 0"), plan.verdicts, store.next_id())
    store.write_load(late.load, readings)
    ingest_load(store, csv, "second", as_of=AS_OF)
    try:
        store.commit_load(late, ledger_events(plan.verdicts, "second", F.lit(AS_OF), "late", 0), last_id)
    except LateWriter:
        pass
    claim("third", json)
    return _live_rows(store).select(F.col("key").alias("file_key"), "status", "attempts", "failed_step", "error", "pipeline", "live_rows")


def _third(key) -> DataFrame:
    """Files by the remainder of their number."""
    return F.substring(key, 6, 6).cast("int") % 3


def job_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over three loads, one a step, left after its second: its progress after every step, and how it stands."""
    store = _store(spark)
    files = folder_files(spark, drop_folder(spark, sf_dir), folder_key)
    for part in range(3):
        ingest_load(store, files.where(_third(F.col("file_key")) == part), f"part-{part}", as_of=AS_OF)
    categorize_loads(store, "nightly", as_of=AS_OF, loads_per_step=1, max_steps=2)
    columns = ["job_id", "sensor_type", "status", "processed", "batches", "failed_batches", "to_load"]
    progress = store.progress().select(F.concat(F.lit("step "), "step").alias("view"), *columns)
    return progress.unionByName(store.job_states().select(F.lit("now").alias("view"), *columns))


PARTLY = Definition(
    "sensor-processing",
    (
        Step("processing.categorize", continue_on_error=True, parameters=THRESHOLDS | {"thresholds.signup": "30;5;45"}),
        Step("processing.insert-results"),
    ),
)


def partly_failed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a job in which some measurements have no value and one type's thresholds cannot be read: a batch fails alone."""
    measurements = standins.measurements(spark, sf_dir).withColumn("value", F.when(F.col("id") % 1777 != 5, F.col("value")))
    plan = plan_job(measurements, BASE, PARTLY, BATCH)
    sizes = failed_batch_sizes(plan.batched, plan.run.failed)
    failed = sizes.select("sensor_type", "batch_number", F.lit("Failed").alias("status"), "rows", "failed_step", "error")
    done = plan.run.results.groupBy("sensor_type", "batch_number").agg(F.sum("count").alias("rows"))
    nothing = F.lit(None).cast("string")
    done = done.select("sensor_type", "batch_number", F.lit("Completed").alias("status"), "rows", nothing.alias("failed_step"), nothing.alias("error"))
    return failed.unionByName(done).select(job_key(BASE, F.col("sensor_type")).alias("job_id"), "*")


SWEPT_FILES = 50


def swept_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inbox stream that also takes up a load whose writer died an hour ago: the files, and the totals of the scan log."""
    store = _store(spark)
    cut = drop_folder(spark, sf_dir, _third(F.col("file_key")) == 0)
    inbox = drop_folder(spark, sf_dir, _third(F.col("file_key")) != 0)
    files = folder_files(spark, cut, folder_key)
    store.claim("nightly", files.select(F.col("file_key").alias("key"), "path"), F.lit(AS_OF - timedelta(hours=1)))
    stream = ingest_stream(
        spark, inbox, store.root, scratch_path(spark, "inbox-log"), max_files=SWEPT_FILES, as_of=AS_OF, key_of=folder_key, orphan_minutes=15
    )
    stream.awaitTermination()
    files = _live_rows(store).select(F.col("key").alias("name"), "status", F.col("attempts").cast("bigint").alias("attempts"), F.col("live_rows").alias("n"))
    totals = scan_totals(store.scans()).select(F.explode(F.create_map(*[x for c in ("total_scans", "total_dispatched", "total_re_dispatched") for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    return files.unionByName(totals, allowMissingColumns=True)


PLAIN = Definition("file-ingestion", (Step("ingest.fetch"), Step("ingest.validate"), Step("ingest.store")))


def converted_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load with conversion and one without: what is stored, and the normalized files of the first."""
    inbox = drop_folder(spark, sf_dir)
    with_files, without = _store(spark), _store(spark)
    load = ingest_folder(with_files, inbox, "folder", as_of=AS_OF, key_of=folder_key)
    ingest_folder(without, inbox, "folder", PLAIN, AS_OF, folder_key)
    sets = {"converted": with_files.measurements(), "files": read_normalized(spark, with_files.converted_path(load)), "plain": without.measurements()}
    first, *rest = [_readings(rows).withColumn("kind", F.lit(kind)) for kind, rows in sets.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with a delivery, a job and a second delivery, compacted; then a third delivery: all tables in short."""
    store, inbox = _store(spark), drop_folder(spark, sf_dir)
    ingest_folder(store, inbox, "first", as_of=AS_OF, key_of=folder_key)
    ingest_folder(store, inbox, "second", as_of=AS_OF, key_of=folder_key)
    categorize_loads(store, "nightly", as_of=AS_OF)
    compact = store.compact(scratch_path(spark, "compacted"))
    later = SensorStore(spark, compact.root)
    csv = folder_files(spark, inbox, folder_key).where(F.col("file_key").endswith(".csv"))
    ingest_load(later, csv, "second", as_of=AS_OF)  # known as committed
    ingest_load(later, csv, "third", as_of=AS_OF)
    count = F.count("*").alias("n")
    text = lambda *columns: F.concat_ws(" ", *columns).alias("what")
    parts = {
        "files": later.files().groupBy(text("status", "attempts")).agg(count),
        "first created": later.files().groupBy(text(F.date_format("created_at", "yyyy"))).agg(count),
        "measurements": later.measurements().groupBy(text(F.lit("load"), "load")).agg(count),
        "categories": later.categorized().groupBy(text("sensor_type", "category")).agg(count),
        "results": later.results().groupBy(text("job_id")).agg(F.sum("count").alias("n")),
        "jobs": later.jobs().select(text("job_id", "status"), F.col("processed").alias("n")),
        "reports": later.reports().groupBy(text(F.lit("load"), "load")).agg(count),
        "not yet categorized": later.measurements(later.last_categorized_load()).groupBy(text("sensor_type")).agg(count),
    }
    first, *rest = [rows.select(F.lit(part).alias("part"), "what", "n") for part, rows in parts.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


ASKED_FILES = 2000


def reingested_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keys of a store asked for again, every seventh file of which is gone: outcomes and live rows."""
    store, inbox = _store(spark), drop_folder(spark, sf_dir)
    ingest_folder(store, inbox, "first", as_of=AS_OF, key_of=folder_key)
    listed = folder_files(spark, inbox, folder_key).select("path", "file_key", F.substring("file_key", 6, 6).cast("int").alias("no")).orderBy("file_key").limit(ASKED_FILES)
    # A file is gone when no file has its name, and a name nobody ever had is asked for beside it.
    renamed = lambda to: F.regexp_replace("path", r"/([^/]+)$", to)
    names = F.when(F.col("no") % 7 == 0, F.array(renamed("/lost-$1"), renamed("/gone/$1"))).otherwise(F.array("path"))
    # The folder is gone over once for all of them.
    asked = listed.select(F.explode(names).alias("path")).collect()
    files, missing, _ = named_files(spark, inbox, sorted(r["path"] for r in asked), folder_key)
    ingest_load(store, files, "second", as_of=AS_OF, missing=missing)
    return _live_rows(store).select(F.col("key").alias("file_key"), "status", "attempts", "live_rows")


QUERIES = {
    "claimed_files": claimed_files,
    "job_running": job_running,
    "partly_failed_job": partly_failed_job,
    "swept_inbox": swept_inbox,
    "converted_load": converted_load,
    "compacted_store": compacted_store,
    "reingested_store": reingested_store,
}

# -- SQL ----------------------------------------------------------------------------------

OUTCOME = "CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN 'Stored' ELSE 'Invalid' END"
STORED_ROWS = "CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN total ELSE 0 END"
ERROR_TEXT = "CASE WHEN fatal IS NOT NULL THEN 'InvalidFile: ' || fatal WHEN bad_rows IS NOT NULL THEN substring('InvalidRows: ' || bad_rows, 1, 2000) END"
NUMBER = "CAST(substr(file_key, 6, 6) AS INTEGER)"

ORACLES = {
    "claimed_files": f"""{FULL}, o AS (
  SELECT file_key, {OUTCOME} AS status, {STORED_ROWS} AS live_rows, {ERROR_TEXT} AS error, file_key LIKE '%.json' AS open FROM verdicts)
SELECT file_key, CASE WHEN open THEN 'Processing' ELSE status END AS status,
  CASE WHEN open THEN 2 WHEN file_key LIKE '%.csv' THEN 3 ELSE 1 END AS attempts,
  CASE WHEN NOT open AND status = 'Invalid' THEN 'ingest.validate' END AS failed_step, CASE WHEN NOT open THEN error END AS error,
  CASE WHEN NOT open THEN 'file-ingestion' END AS pipeline, live_rows FROM o""",
    "job_running": f"""
WITH s AS (SELECT sensor_type, {NUMBER} % 3 AS part FROM ({STORED})),
types(sensor_type) AS (VALUES ('temperature'), ('humidity'), ('pressure'), ('vibration'), ('co2')),
steps(step) AS (VALUES (0), (1), (2)),
per AS (SELECT sensor_type, part, count(*) AS n FROM s GROUP BY ALL),
p AS (
  SELECT t.sensor_type, step, CAST(coalesce(sum(n), 0) AS BIGINT) AS processed, CAST(coalesce(sum((n + 499) // 500), 0) AS BIGINT) AS batches
  FROM types t CROSS JOIN steps LEFT JOIN per ON per.sensor_type = t.sensor_type AND part < step GROUP BY t.sensor_type, step)
SELECT 'step ' || step AS view, 'nightly-' || sensor_type AS job_id, sensor_type, 'Running' AS status, processed, batches, 0 AS failed_batches, step AS to_load FROM p
UNION ALL SELECT 'now', 'nightly-' || sensor_type, sensor_type, 'Running', processed, batches, 0, step FROM p WHERE step = 2""",
    "partly_failed_job": """
WITH b AS (
  SELECT event_id, event_type AS sensor_type, event_id % 1777 = 5 AS unread,
    (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 + 1 AS batch_number FROM events),
f AS (
  SELECT sensor_type, batch_number, count(*) AS rows, CASE WHEN sensor_type = 'signup' THEN 'Invalid thresholds ''30;5;45'', expected ''low;high;critical'' in ascending order'
    ELSE 'Measurement ' || min(event_id) FILTER (WHERE unread) || ' has no value' END AS error FROM b GROUP BY sensor_type, batch_number)
SELECT 'job-' || sensor_type AS job_id, sensor_type, batch_number, CASE WHEN error IS NULL THEN 'Completed' ELSE 'Failed' END AS status, rows,
  CASE WHEN error IS NOT NULL THEN 'processing.categorize' END AS failed_step, error FROM f""",
    "swept_inbox": f"""{FULL}, o AS (
  SELECT file_key, {OUTCOME} AS status, {STORED_ROWS} AS n, {NUMBER} % 3 = 0 AS cut FROM verdicts)
SELECT file_key AS name, status, CASE WHEN cut THEN 2 ELSE 1 END AS attempts, n FROM o
UNION ALL SELECT 'total_scans', NULL, NULL, (count(*) + {SWEPT_FILES - 1}) // {SWEPT_FILES} FROM o WHERE NOT cut
UNION ALL SELECT 'total_dispatched', NULL, NULL, count(*) FROM o WHERE NOT cut
UNION ALL SELECT 'total_re_dispatched', NULL, NULL, count(*) FROM o WHERE cut""",
    "converted_load": f"SELECT s.*, kind FROM ({STORED}) s CROSS JOIN (VALUES ('converted'), ('files'), ('plain')) AS k(kind)",
    "compacted_store": f"""{FULL}, v AS (
  SELECT file_key, {OUTCOME} AS status, {STORED_ROWS} AS n, file_key LIKE '%.csv' AS again FROM verdicts),
s AS (SELECT r.*, file_key LIKE '%.csv' AS again, {CATEGORY} AS category FROM ({STORED}) r)
SELECT 'files' AS part, status || ' ' || CASE WHEN again THEN 3 ELSE 2 END AS what, count(*) AS n FROM v GROUP BY ALL
UNION ALL SELECT 'first created', '2030', count(*) FROM v
UNION ALL SELECT 'measurements', 'load ' || CASE WHEN again THEN 3 ELSE 2 END, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'categories', sensor_type || ' ' || category, count(*) FROM s WHERE NOT again GROUP BY ALL
UNION ALL SELECT 'results', 'nightly-' || sensor_type, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'jobs', 'nightly-' || sensor_type || ' Completed', count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'reports', 'load ' || load, count(*) FROM v, (VALUES (1), (2), (3)) AS l(load) WHERE status = 'Invalid' AND (load < 3 OR again) GROUP BY ALL
UNION ALL SELECT 'not yet categorized', sensor_type, count(*) FROM s WHERE again GROUP BY ALL""",
    "reingested_store": f"""{FULL}, v AS (
  SELECT file_key, {OUTCOME} AS status, {STORED_ROWS} AS live_rows, {NUMBER} % 7 = 0 AS gone, row_number() OVER (ORDER BY file_key) <= {ASKED_FILES} AS asked FROM verdicts)
SELECT file_key, status, CASE WHEN asked THEN 2 ELSE 1 END AS attempts, live_rows FROM v
UNION ALL SELECT 'lost-' || file_key, 'Missing', 1, 0 FROM v WHERE asked AND gone""",
}
