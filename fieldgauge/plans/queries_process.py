"""Registered queries of processing, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import merge_counts, parameter_number
from ..functions.text import job_key
from ..functions.thresholds import threshold_struct
from ..functions.times import instant
from ..operators.batches import assign_batches, batch_ranges, eligible, fetch_page
from ..operators.reports import job_view, list_jobs, list_results
from ..operators.results import (
    categorize,
    categorize_in_place,
    category_histogram,
    histogram_map,
    job_progress,
    job_totals,
    per_sensor_results,
    staged_rows,
)
from . import standins
from .process import plan_job
from .steps import Definition, Step, definition_errors

BASE = "job"
BATCH = 500
# One type has no thresholds and stays NORMAL.
THRESHOLDS = {
    "thresholds.click": "10;100;200",
    "thresholds.view": "5;50;150",
    "thresholds.purchase": "20,80,240",
    "thresholds.error": "1;10;30",
}
STEP_LIST = Definition(
    "sensor-processing",
    (
        Step("processing.categorize", parameters=THRESHOLDS),
        Step("processing.update-measurements", enabled=False),
        Step("processing.insert-results"),
        Step("processing.cleanup", continue_on_error=True),
    ),
)

# -- Spark --------------------------------------------------------------------------------


def _categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorize(assign_batches(standins.measurements(spark, sf_dir), BATCH), THRESHOLDS)


def _with_job(rows: DataFrame) -> DataFrame:
    return rows.select(job_key(BASE, F.col("sensor_type")).alias("job_id"), "*")


def per_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_job(per_sensor_results(_categorized(spark, sf_dir)))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_ranges(assign_batches(standins.measurements(spark, sf_dir), BATCH)).drop("processed")


def scheduled_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch size 100 for three batches, 250 for two, then 400."""
    sizes = [(1, 100), (4, 250), (6, 400)]
    return batch_ranges(assign_batches(standins.measurements(spark, sf_dir), sizes)).drop("processed")


def pending_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what no other job categorized: fresh rows and those of this job's earlier attempt."""
    job = job_key(BASE, F.col("sensor_type"))
    batched = assign_batches(standins.known_measurements(spark, sf_dir, BASE), BATCH, job=job)
    return categorize(batched, THRESHOLDS).select("id", "sensor_type", "batch_number", "category")


def limited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two batches of two types after a cursor."""
    batched = assign_batches(standins.measurements(spark, sf_dir), BATCH, max_batches=2, after_id=99, sensor_types=["click", "view"])
    return batched.select("id", "sensor_type", "batch_number")


def updated_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories written back over measurements that partly had one before."""
    known = standins.known_measurements(spark, sf_dir, BASE).withColumn("categorized_at", F.lit(None).cast("timestamp"))
    job = job_key(BASE, F.col("sensor_type"))
    updated = categorize_in_place(known, THRESHOLDS, job, instant(standins.AS_OF))
    return updated.select("id", "sensor_type", "category", "categorized_by_job", F.col("categorized_at").isNotNull().alias("updated"))


def staged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sensor results from staged categories joined back to the measurements."""
    staged = _categorized(spark, sf_dir).select("id", "category", "batch_number")
    return _with_job(per_sensor_results(staged_rows(staged, standins.measurements(spark, sf_dir))))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_histogram(_categorized(spark, sf_dir), ("sensor_type", "batch_number"))


def merged_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count maps of the odd and of the even batches of each job, added key by key."""
    counts = category_histogram(_categorized(spark, sf_dir).withColumn("odd", F.col("batch_number") % 2 == 1), ("sensor_type", "odd"))
    maps = histogram_map(counts, ("sensor_type", "odd"))
    # Maps do not compare, so each side is picked as entries: at most four per job.
    nothing = F.array().cast("array<struct<key:string,value:bigint>>")
    entries = lambda mine: F.map_from_entries(F.coalesce(F.max(F.when(mine, F.map_entries("categories"))), nothing))
    picked = maps.groupBy("sensor_type").agg(entries(F.col("odd")).alias("_odd"), entries(~F.col("odd")).alias("_even"))
    merged = picked.select("sensor_type", merge_counts(F.col("_odd"), F.col("_even")).alias("categories"))
    count = lambda name: F.coalesce(F.try_element_at("categories", F.lit(name)), F.lit(0)).alias(name.lower())
    return merged.select("sensor_type", *[count(n) for n in ("LOW", "NORMAL", "HIGH", "CRITICAL")])


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job totals, with the batches that hold a peak value counted as failed."""
    batched = assign_batches(standins.measurements(spark, sf_dir), BATCH)
    return job_totals(batch_ranges(batched, F.col("value") > 300), BASE)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_progress(batch_ranges(assign_batches(standins.measurements(spark, sf_dir), BATCH)))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_page(standins.measurements(spark, sf_dir), "click", 250, BATCH)


def results_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_results(per_sensor(spark, sf_dir), "job-view", 5000)


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one batch, read again by the range of ids that it is known by."""
    rows = standins.measurements(spark, sf_dir)
    batch = batch_ranges(assign_batches(rows, BATCH, sensor_types=["view"])).where("batch_number = 2").first()
    if batch is None:
        batch = batch_ranges(assign_batches(rows, BATCH, sensor_types=["view"])).orderBy("batch_number").first()
    return eligible(rows, sensor_types=["view"], first_id=batch["first_id"], last_id=batch["last_id"])


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = standins.table(spark, sf_dir, "events")
    return events.groupBy(F.format_string("user-%d-%s", "user_id", "event_type").alias("job_id")).agg(
        F.count(F.lit(1)).alias("processed"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("started_at")
    )


def jobs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of a type as a job: the newest two hundred."""
    return list_jobs(_jobs(spark, sf_dir))


def job_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job by its id."""
    return job_view(_jobs(spark, sf_dir), "user-7-click")


def step_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of text parameters, missing and unreadable ones too, and thresholds out of texts: each order as a step."""
    orders = standins.table(spark, sf_dir, "orders")
    texts = F.expr("""map('maxRows', string(o_custkey % 1000), IF(o_orderkey % 3 = 0, 'ratio', 'other'), concat('0.', o_orderkey % 100),
        'broken', o_orderpriority)""")
    thresholds = F.expr("CASE WHEN o_orderkey % 5 > 0 THEN concat_ws(IF(o_orderkey % 2 = 0, ';', ','), o_custkey % 10, 10 + o_orderkey % 10, 20) END")
    rows = orders.select("o_orderkey", texts.alias("p"), threshold_struct(thresholds).alias("t"))
    number = lambda name, fallback, kind: parameter_number(F.col("p"), name, fallback, kind)
    return rows.select(
        "o_orderkey",
        number("maxRows", 5, "int").alias("max_rows"),
        number("ratio", 0.25, "double").alias("ratio"),
        number("broken", -1, "bigint").alias("broken"),
        "t.low",
        "t.high",
        "t.critical",
    )


def step_list_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per-sensor results through a step list."""
    plan = plan_job(standins.measurements(spark, sf_dir), BASE, STEP_LIST, BATCH)
    return _with_job(plan.run.results)


def bad_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a definition of two steps named by its priority and status."""
    orders = standins.table(spark, sf_dir, "orders")
    step = "named_struct('activity', {0}, 'enabled', true, 'maxAttempts', int(o_custkey % 40) - 1, 'timeoutSeconds', int(o_orderkey % 50), 'heartbeatTimeoutSeconds', 20)"
    first = "CASE o_orderpriority WHEN '1-URGENT' THEN 'ingest.fetch' WHEN '2-HIGH' THEN 'processing.categorize' ELSE 'ingest.store' END"
    second = "CASE o_orderstatus WHEN 'F' THEN 'ingest.validate' WHEN 'O' THEN 'processing.cleanup' ELSE 'unheard-of' END"
    definitions = orders.selectExpr(
        "concat(CASE WHEN o_orderpriority = '2-HIGH' THEN 'processing-' ELSE 'file-ingestion-' END, o_custkey) AS name",
        "o_orderkey AS version",
        f"CASE WHEN o_orderpriority = '5-LOW' THEN array() ELSE array({step.format(first)}, {step.format(second)}) END AS steps",
    )
    return definition_errors(definitions)


QUERIES = {
    "per_sensor_results": per_sensor,
    "batch_ranges": ranges,
    "scheduled_batch_ranges": scheduled_ranges,
    "pending_categories": pending_categories,
    "limited_batches": limited_batches,
    "updated_measurements": updated_measurements,
    "staged_results": staged_results,
    "category_histogram": histogram,
    "merged_categories": merged_categories,
    "job_totals": totals,
    "job_progress": progress,
    "keyset_page": keyset_page,
    "job_results_listing": results_listing,
    "jobs_listing": jobs_listing,
    "batch_rows": batch_rows,
    "job_row": job_row,
    "step_parameters": step_parameters,
    "step_list_results": step_list_results,
    "definition_errors": bad_definitions,
}

# -- SQL ----------------------------------------------------------------------------------

NUMBERED = """numbered AS (
  SELECT event_id AS id, event_type AS sensor_type, user_id AS sensor_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)"""
BATCHED = f"{NUMBERED},\nbatched AS (SELECT *, CAST((rn - 1) // 500 + 1 AS INTEGER) AS batch_number FROM numbered)"
CATEGORY = """CASE sensor_type
    WHEN 'click' THEN CASE WHEN value >= 200 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN value < 10 THEN 'LOW' ELSE 'NORMAL' END
    WHEN 'view' THEN CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 50 THEN 'HIGH' WHEN value < 5 THEN 'LOW' ELSE 'NORMAL' END
    WHEN 'purchase' THEN CASE WHEN value >= 240 THEN 'CRITICAL' WHEN value >= 80 THEN 'HIGH' WHEN value < 20 THEN 'LOW' ELSE 'NORMAL' END
    WHEN 'error' THEN CASE WHEN value >= 30 THEN 'CRITICAL' WHEN value >= 10 THEN 'HIGH' WHEN value < 1 THEN 'LOW' ELSE 'NORMAL' END
    ELSE 'NORMAL' END"""
CATEGORIZED = f"{BATCHED},\ncategorized AS (SELECT *, {CATEGORY} AS category FROM batched)"
RANGES = "SELECT sensor_type, batch_number, min(id) AS first_id, max(id) AS last_id, count(*) AS count FROM batched GROUP BY ALL"
RESULTS = """SELECT 'job-' || sensor_type AS job_id, sensor_type, batch_number, sensor_id, count(*) AS count, min(value) AS min, max(value) AS max,
       round_even(sum(CAST(round(value * 10000) AS BIGINT)) / count(*), 0) / 10000 AS avg,
       count(*) FILTER (WHERE category = 'LOW') AS low_count, count(*) FILTER (WHERE category = 'NORMAL') AS normal_count,
       count(*) FILTER (WHERE category = 'HIGH') AS high_count, count(*) FILTER (WHERE category = 'CRITICAL') AS critical_count
FROM categorized GROUP BY sensor_type, batch_number, sensor_id"""
KNOWN = """known AS (
  SELECT event_id AS id, event_type AS sensor_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
pending AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY sensor_type ORDER BY id) - 1) // 500 + 1 AS INTEGER) AS batch_number
  FROM known WHERE k >= 20)"""

ORACLES = {
    "per_sensor_results": f"WITH {CATEGORIZED}\n{RESULTS}",
    "staged_results": f"WITH {CATEGORIZED}\n{RESULTS}",
    "step_list_results": f"WITH {CATEGORIZED}\n{RESULTS}",
    "job_results_listing": f"""WITH {CATEGORIZED}, results AS ({RESULTS})
SELECT * FROM results WHERE job_id = 'job-view' ORDER BY batch_number, sensor_id LIMIT 5000""",
    "batch_ranges": f"WITH {BATCHED}\n{RANGES}",
    "scheduled_batch_ranges": f"""WITH {NUMBERED},
batched AS (SELECT *, CAST(CASE WHEN rn <= 300 THEN (rn - 1) // 100 + 1 WHEN rn <= 800 THEN (rn - 301) // 250 + 4 ELSE (rn - 801) // 400 + 6 END AS INTEGER)
                   AS batch_number FROM numbered)
{RANGES}""",
    "pending_categories": f"WITH {KNOWN}\nSELECT id, sensor_type, batch_number, {CATEGORY} AS category FROM pending",
    "limited_batches": """
WITH numbered AS (
  SELECT event_id AS id, event_type AS sensor_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn
  FROM events WHERE event_id > 99 AND event_type IN ('click', 'view'))
SELECT id, sensor_type, CAST((rn - 1) // 500 + 1 AS INTEGER) AS batch_number FROM numbered WHERE rn <= 1000""",
    "updated_measurements": f"""WITH {KNOWN}
SELECT id, sensor_type, CASE WHEN k < 20 THEN 'NORMAL' ELSE {CATEGORY} END AS category,
       CASE WHEN k < 20 THEN 'before' ELSE 'job-' || sensor_type END AS categorized_by_job, k >= 20 AS updated FROM known""",
    "category_histogram": f"WITH {CATEGORIZED}\nSELECT sensor_type, batch_number, category, count(*) AS count FROM categorized GROUP BY ALL",
    "merged_categories": f"""WITH {CATEGORIZED}
SELECT sensor_type, count(*) FILTER (WHERE category = 'LOW') AS low, count(*) FILTER (WHERE category = 'NORMAL') AS normal,
       count(*) FILTER (WHERE category = 'HIGH') AS high, count(*) FILTER (WHERE category = 'CRITICAL') AS critical
FROM categorized GROUP BY sensor_type""",
    "job_totals": f"""WITH {BATCHED},
ranges AS (SELECT sensor_type, batch_number, max(id) AS last_id, count(*) AS n, bool_or(value > 300) AS failed FROM batched GROUP BY ALL)
SELECT 'job-' || sensor_type AS job_id, sensor_type, CAST(sum(n) AS BIGINT) AS processed, count(*) AS batches,
       count(*) FILTER (WHERE failed) AS failed_batches, max(last_id) AS cursor
FROM ranges GROUP BY sensor_type""",
    "job_progress": f"""WITH {BATCHED}, ranges AS ({RANGES})
SELECT sensor_type, batch_number, last_id AS cursor, batch_number AS batches,
       CAST(sum(count) OVER (PARTITION BY sensor_type ORDER BY batch_number) AS BIGINT) AS processed FROM ranges""",
    "keyset_page": "SELECT event_id AS id FROM events WHERE event_type = 'click' AND event_id > 250 ORDER BY event_id LIMIT 500",
    "jobs_listing": """
SELECT 'user-' || user_id || '-' || event_type AS job_id, count(*) AS processed, epoch_us(min(ts)) AS started_at
FROM events GROUP BY user_id, event_type ORDER BY started_at DESC, job_id LIMIT 200""",
    "batch_rows": f"""WITH {NUMBERED}
SELECT id, sensor_type, sensor_id, value FROM numbered WHERE sensor_type = 'view'
  AND (rn - 1) // 500 = (SELECT CASE WHEN max(rn) > 500 THEN 1 ELSE 0 END FROM numbered WHERE sensor_type = 'view')""",
    "job_row": """
SELECT 'user-7-click' AS job_id, count(*) AS processed, epoch_us(min(ts)) AS started_at
FROM events WHERE user_id = 7 AND event_type = 'click' GROUP BY user_id""",
    "step_parameters": """
SELECT o_orderkey, CAST(o_custkey % 1000 AS INTEGER) AS max_rows, CASE WHEN o_orderkey % 3 = 0 THEN CAST('0.' || (o_orderkey % 100) AS DOUBLE) ELSE 0.25 END AS ratio,
  CAST(-1 AS BIGINT) AS broken, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 10 AS DOUBLE) END AS low,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(10 + o_orderkey % 10 AS DOUBLE) END AS high, CASE WHEN o_orderkey % 5 > 0 THEN 20.0::DOUBLE END AS critical
FROM orders""",
    "definition_errors": """
WITH named AS (
  SELECT CASE WHEN o_orderpriority = '2-HIGH' THEN 'processing-' ELSE 'file-ingestion-' END || o_custkey AS name, o_orderkey AS version,
         o_orderpriority = '5-LOW' AS empty, o_custkey % 40 - 1 < 0 OR o_orderkey % 50 <= 0 AS bad_number,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'processing.categorize, processing.update-measurements, processing.insert-results, processing.cleanup'
              ELSE 'ingest.fetch, ingest.validate, ingest.convert, ingest.store' END AS allowed,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'ingest.fetch' WHEN '2-HIGH' THEN 'processing.categorize' ELSE 'ingest.store' END AS a0,
         CASE o_orderstatus WHEN 'F' THEN 'ingest.validate' WHEN 'O' THEN 'processing.cleanup' ELSE 'unheard-of' END AS a1
  FROM orders),
steps AS (
  SELECT name, version, allowed, bad_number, 0 AS position, a0 AS activity FROM named WHERE NOT empty
  UNION ALL SELECT name, version, allowed, bad_number, 1, a1 FROM named WHERE NOT empty)
SELECT name, version, CAST(NULL AS INTEGER) AS position, 'A pipeline needs at least one step' AS error FROM named WHERE empty
UNION ALL
SELECT name, version, position, 'Unknown step ''' || activity || '''. Allowed: ' || allowed FROM steps
WHERE NOT list_contains(string_split(allowed, ', '), activity)
UNION ALL
SELECT name, version, position, 'Step ''' || activity || ''': invalid retry/timeout values' FROM steps WHERE bad_number""",
}
