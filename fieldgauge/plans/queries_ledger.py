"""Registered queries over ledger, objects and versions, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import instant
from ..operators.audit import audit, duplicate_lines, false_invalid_files, orphan_measurements
from ..operators.dispatch import dispatch_counts, dispatch_plan, orphans, scan_totals
from ..operators.ledger import finalized_state, latest_by_key, ledger_view
from ..operators.reports import file_status, files_per_status, list_files, measurements_per_type
from ..operators.versions import append_version, get_version, latest_versions, next_versions, version_history
from ..sources.listing import count_by_prefix, listing_page, visible_objects
from . import standins

MAX_FILES = 2000
MAX_IN_FLIGHT = 3000
AUDIT_AS_OF = "2001-09-01 00:00:00"
STUCK_MINUTES = 60 * 24 * 365

# -- Spark --------------------------------------------------------------------------------


def _micros(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*[F.unix_micros(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_per_status(standins.ledger_files(spark, sf_dir))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements_per_type(standins.known_measurements(spark, sf_dir, "job"))


def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_prefix(standins.objects(spark, sf_dir), f"{standins.RUN_PREFIX}/")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(standins.stored_lines(spark, sf_dir))


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_measurements(standins.ledger_files(spark, sf_dir), standins.stored_lines(spark, sf_dir))


def false_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return false_invalid_files(standins.ledger_files(spark, sf_dir))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.ledger_files(spark, sf_dir)
    jobs = standins.table(spark, sf_dir, "orders").selectExpr(
        "concat('run-', o_orderkey) AS job_id", "CASE o_orderstatus WHEN 'P' THEN 'Failed' ELSE 'Completed' END AS status"
    )
    staging = standins.table(spark, sf_dir, "events").selectExpr("concat('run-', user_id) AS job_id")
    lines = standins.stored_lines(spark, sf_dir)
    objects = count_by_prefix(standins.objects(spark, sf_dir))
    return audit(files, lines, jobs, objects, standins.RUN_PREFIX, 15000, 5000, 4, staging)


def files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(list_files(standins.ledger_files(spark, sf_dir), "Invalid", 5000), "updated_at")


def object_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of processed objects after a token."""
    listing = visible_objects(standins.objects(spark, sf_dir), "processed/", ".error.json")
    return listing_page(listing, 1000, "processed/run/file-000000100.csv").select("key", "size")


def _inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_objects(standins.objects(spark, sf_dir), "incoming/")


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch_plan(_inbox(spark, sf_dir), standins.in_flight(spark, sf_dir), MAX_FILES, MAX_IN_FLIGHT)


def dispatch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch_counts(dispatch(spark, sf_dir))


def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans(standins.objects(spark, sf_dir), standins.in_flight(spark, sf_dir), STUCK_MINUTES, instant(AUDIT_AS_OF))
    return _micros(found, "last_modified")


def scan_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of orders as one scan."""
    scans = standins.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("dispatched"), F.count_if(F.col("o_orderstatus") == "P").alias("re_dispatched")
    )
    return scan_totals(scans)


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the file of every line's order ended up."""
    keys = standins.stored_lines(spark, sf_dir).select(F.col("file_key").alias("key")).distinct()
    waiting = standins.objects(spark, sf_dir).where(~F.col("key").startswith("processing/"))
    return finalized_state(keys, waiting)


def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger row of every file with the place it lies in and its size tag."""
    tagged = standins.objects(spark, sf_dir).withColumn("tags", F.create_map(F.lit("size"), F.col("size").cast("string")))
    joined = file_status(standins.ledger_files(spark, sf_dir), visible_objects(tagged, exclude_suffix=".error.json"))
    place = F.element_at(F.map_keys("objects"), 1)
    return joined.select("key", "status", place.alias("location"), F.element_at("objects", place)["size"].alias("size_tag"), F.size("objects").alias("places"))


def ledger_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ledger_view(standins.ledger_event_log(spark, sf_dir), ["updated_at", "seq"])
    return _micros(view.select("key", "status", "run_id", "seq", "attempts", "created_at", "updated_at"), "created_at", "updated_at")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = standins.ledger_event_log(spark, sf_dir)
    return _micros(latest_by_key(log, ["key"], ["updated_at", "seq"]).select("key", "status", "updated_at", "seq"), "updated_at")


def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_versions(standins.versioned_rows(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_history(standins.versioned_rows(spark, sf_dir))


def one_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of one name next to an exact version of another."""
    rows = standins.versioned_rows(spark, sf_dir)
    return get_version(rows, 70).unionByName(get_version(rows, 1028, 4))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "customer").selectExpr("c_custkey AS name", "c_mktsegment AS comment", "c_nationkey")


def upcoming_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_versions(standins.versioned_rows(spark, sf_dir), _names(spark, sf_dir))


def appended_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer saved as a new version of its own name."""
    new = _names(spark, sf_dir).select("name", "comment", F.lit("reset").alias("o_orderstatus"))
    rows = standins.versioned_rows(spark, sf_dir)
    saved = append_version(rows, new)
    return rows.unionByName(saved)


QUERIES = {
    "files_per_status": status_counts,
    "measurements_per_type": type_counts,
    "objects_per_prefix": prefix_counts,
    "duplicate_lines": duplicates,
    "orphan_measurements": orphan_counts,
    "false_invalid_files": false_invalid,
    "audit_report": audit_report,
    "files_listing": files_listing,
    "object_listing_page": object_page,
    "dispatch_plan": dispatch,
    "dispatch_counts": dispatch_counters,
    "orphan_redispatch": orphan_files,
    "scan_totals": scan_log_totals,
    "finalized_lookup": finalized,
    "file_status": file_states,
    "ledger_current": ledger_current,
    "latest_by_key": latest_state,
    "latest_versions": newest_versions,
    "version_history": history,
    "get_version": one_version,
    "next_versions": upcoming_versions,
    "appended_versions": appended_versions,
}

# -- SQL ----------------------------------------------------------------------------------

KEY = "'run/' || CASE WHEN {0} % 50 = 7 THEN 'poison-' ELSE '' END || 'file-' || lpad(CAST({0} AS VARCHAR), 9, '0') || '.csv'"
FILES = f"""files AS (
  SELECT {KEY.format('o_orderkey')} AS key,
         CASE o_orderstatus WHEN 'F' THEN 'Stored' WHEN 'O' THEN 'Processing' ELSE 'Invalid' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'IOException: disk gone'
                                                 ELSE 'InvalidRows: 1/4 invalid rows' END END AS error,
         CAST(o_orderkey % 7 + 1 AS INTEGER) AS stored_count, o_orderdate AS updated_at, o_orderpriority FROM orders)"""
LINES = f"lines AS (SELECT {KEY.format('l_orderkey')} AS file_key, l_linenumber AS line_number, l_returnflag FROM lineitem)"
OBJECTS = f"""placed AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'processed/' WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'incoming/' ELSE 'processing/' END
                            ELSE 'invalid/' END AS prefix, {KEY.format('o_orderkey')} AS relative, CAST(round_even(trunc(o_totalprice), 0) AS BIGINT) AS size,
         o_orderdate AS last_modified, o_orderstatus FROM orders)"""
IN_FLIGHT = f"in_flight AS (SELECT {KEY.format('o_orderkey')} AS key FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')"
PLAN = f"""{OBJECTS}, {IN_FLIGHT},
first AS (SELECT prefix || relative AS key, relative FROM placed WHERE prefix = 'incoming/' ORDER BY prefix || relative LIMIT 2001),
numbered AS (SELECT key, relative IN (SELECT key FROM in_flight) AS running, CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS position FROM first),
counted AS (
  SELECT *, coalesce(sum(CASE WHEN running THEN 0 ELSE 1 END) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         (SELECT least(greatest(3000 - count(*), 0), 2000) FROM in_flight) AS budget FROM numbered),
plan AS (
  SELECT key, position, CASE WHEN position > 2000 THEN 'beyond' WHEN before >= budget THEN 'throttled'
                             WHEN running THEN 'already_running' ELSE 'dispatched' END AS state FROM counted)"""
LOG = """log AS (
  SELECT 'file-' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '.csv' AS key,
         CASE o_orderstatus WHEN 'F' THEN 'Stored' WHEN 'O' THEN 'Processing' ELSE 'Invalid' END AS status,
         o_orderpriority AS run_id, o_orderdate AS updated_at, o_orderkey AS seq FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, seq DESC) AS rn FROM log)"""
VERSIONS = "SELECT o_custkey AS name, o_orderkey AS version, o_orderpriority AS comment, o_orderstatus FROM orders"

# Status words, prefixes and check names of the audit.
ORACLES = {
    "files_per_status": f"WITH {FILES}\nSELECT status, count(*) AS files FROM files GROUP BY status",
    "measurements_per_type": """
SELECT event_type AS sensor_type, count(*) AS total, count(*) FILTER (WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) < 30) AS categorized
FROM events GROUP BY event_type""",
    "objects_per_prefix": f"""WITH {OBJECTS},
prefixes(prefix) AS (VALUES ('incoming/'), ('processing/'), ('processed/'), ('invalid/'), ('converted/'))
SELECT p.prefix, count(o.relative) AS objects FROM prefixes p LEFT JOIN placed o ON o.prefix = p.prefix GROUP BY p.prefix""",
    "duplicate_lines": f"WITH {LINES}\nSELECT file_key, line_number, count(*) AS copies FROM lines GROUP BY ALL HAVING count(*) > 1",
    "orphan_measurements": f"""WITH {FILES}, {LINES}
SELECT file_key, status, count(*) AS measurements FROM lines JOIN files ON key = file_key WHERE status <> 'Stored' GROUP BY ALL""",
    "false_invalid_files": f"""WITH {FILES}
SELECT key, error FROM files WHERE status = 'Invalid' AND key NOT LIKE '%poison%' AND error NOT LIKE 'Invalid%'""",
    "audit_report": f"""WITH {FILES}, {LINES}, {OBJECTS},
f AS (
  SELECT count(*) FILTER (WHERE status = 'Stored') AS stored, count(*) FILTER (WHERE status = 'Invalid') AS invalid,
         count(*) FILTER (WHERE key LIKE '%poison%' AND status <> 'Invalid') AS poison,
         CAST(coalesce(sum(stored_count) FILTER (WHERE status = 'Stored'), 0) AS BIGINT) AS stored_rows,
         count(*) FILTER (WHERE status = 'Invalid' AND key NOT LIKE '%poison%' AND error NOT LIKE 'Invalid%') AS false_invalid FROM files),
o AS (
  SELECT count(*) FILTER (WHERE prefix IN ('incoming/', 'processing/')) AS waiting, count(*) FILTER (WHERE prefix = 'processed/') AS processed,
         count(*) FILTER (WHERE prefix = 'invalid/') AS rejected FROM placed),
m AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS uncategorized FROM lines),
d AS (SELECT count(*) AS n FROM (SELECT 1 FROM lines GROUP BY file_key, line_number HAVING count(*) > 1)),
r AS (SELECT count(*) AS n FROM lines JOIN files ON key = file_key WHERE status <> 'Stored'),
j AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS n FROM orders),
s AS (SELECT count(*) AS n FROM events),
facts AS (
  SELECT f.*, o.*, m.n AS measurements, m.uncategorized, d.n AS duplicates, r.n AS orphans, j.n AS unfinished, s.n AS staged FROM f, o, m, d, r, j, s)
SELECT 'all files consumed' AS name, waiting AS observed, 0 AS expected, waiting = 0 AS ok FROM facts
UNION ALL SELECT 'processed and invalid files add up', processed + rejected, 15000, processed + rejected = 15000 FROM facts
UNION ALL SELECT 'invalid files as expected', rejected, 5000, rejected = 5000 FROM facts
UNION ALL SELECT 'no file rejected for technical reasons only', false_invalid, 0, false_invalid = 0 FROM facts
UNION ALL SELECT 'stored files match the objects', stored, processed, stored = processed AND invalid = rejected FROM facts
UNION ALL SELECT 'every poison file rejected', poison, 0, poison = 0 FROM facts
UNION ALL SELECT 'measurements match the stored rows', measurements, stored_rows, measurements = stored_rows AND measurements = stored * 4 FROM facts
UNION ALL SELECT 'no duplicated measurement', duplicates, 0, duplicates = 0 FROM facts
UNION ALL SELECT 'no measurement of a rejected file', orphans, 0, orphans = 0 FROM facts
UNION ALL SELECT 'every measurement categorized', uncategorized, 0, uncategorized = 0 FROM facts
UNION ALL SELECT 'all processing jobs completed', unfinished, 0, unfinished = 0 FROM facts
UNION ALL SELECT 'staging empty', staged, 0, staged = 0 FROM facts""",
    "files_listing": f"""WITH {FILES}
SELECT key, status, error, stored_count, epoch_us(updated_at) AS updated_at, o_orderpriority FROM files
WHERE status = 'Invalid' ORDER BY files.updated_at DESC, key LIMIT 1000""",
    "object_listing_page": f"""WITH {OBJECTS}
SELECT prefix || relative AS key, size FROM placed WHERE prefix = 'processed/' AND prefix || relative > 'processed/run/file-000000100.csv'
ORDER BY prefix || relative LIMIT 1000""",
    "dispatch_plan": f"WITH {PLAN}\nSELECT key, position, state FROM plan",
    "dispatch_counts": f"""WITH {PLAN},
c AS (
  SELECT count(*) FILTER (WHERE state <> 'beyond') AS listed, count(*) FILTER (WHERE state = 'dispatched') AS dispatched,
         count(*) FILTER (WHERE state = 'already_running') AS already_running, count(*) FILTER (WHERE state = 'throttled') AS throttled,
         count(*) FILTER (WHERE state = 'beyond') AS beyond FROM plan)
SELECT listed, dispatched, already_running, throttled, beyond > 0 AND dispatched > 0 AND throttled = 0 AS has_more FROM c""",
    "orphan_redispatch": f"""WITH {OBJECTS}, {IN_FLIGHT}
SELECT relative AS key, epoch_us(last_modified) AS last_modified FROM placed
WHERE prefix = 'processing/' AND last_modified < TIMESTAMP '2001-09-01 00:00:00' - INTERVAL 525600 MINUTE
  AND relative NOT IN (SELECT key FROM in_flight)""",
    "scan_totals": """
WITH scans AS (
  SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderstatus = 'F') AS dispatched,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS re_dispatched FROM orders GROUP BY day)
SELECT count(*) AS total_scans, CAST(sum(dispatched) AS BIGINT) AS total_dispatched, CAST(sum(re_dispatched) AS BIGINT) AS total_re_dispatched FROM scans""",
    "finalized_lookup": f"""WITH {LINES}, {OBJECTS},
keys AS (SELECT DISTINCT file_key AS key FROM lines)
SELECT k.key, CASE o.prefix WHEN 'incoming/' THEN 'waiting' WHEN 'processed/' THEN 'processed' WHEN 'invalid/' THEN 'invalid' ELSE 'missing' END AS finalized_as
FROM keys k LEFT JOIN placed o ON o.relative = k.key AND o.prefix <> 'processing/'""",
    "file_status": f"""WITH {FILES}, {OBJECTS}
SELECT key, status, prefix || relative AS location, CAST(size AS VARCHAR) AS size_tag, 1 AS places FROM files JOIN placed ON relative = key""",
    "ledger_current": f"""WITH {LOG},
runs AS (SELECT key, CAST(count(DISTINCT run_id) AS INTEGER) AS attempts, min(updated_at) AS created FROM log GROUP BY key)
SELECT key, status, run_id, seq, attempts, epoch_us(created) AS created_at, epoch_us(updated_at) AS updated_at
FROM ranked JOIN runs USING (key) WHERE rn = 1""",
    "latest_by_key": f"WITH {LOG}\nSELECT key, status, epoch_us(updated_at) AS updated_at, seq FROM ranked WHERE rn = 1",
    "latest_versions": f"""WITH v AS ({VERSIONS})
SELECT * FROM v WHERE (name, version) IN (SELECT (name, max(version)) FROM v GROUP BY name)""",
    "version_history": VERSIONS,
    "get_version": f"""WITH v AS ({VERSIONS})
SELECT * FROM v WHERE name = 70 AND version = (SELECT max(version) FROM v WHERE name = 70)
UNION ALL SELECT * FROM v WHERE name = 1028 AND version = 4""",
    "next_versions": """
SELECT c_custkey AS name, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "appended_versions": f"""{VERSIONS}
UNION ALL
SELECT c_custkey, coalesce(newest, 0) + 1, c_mktsegment, 'reset' FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
}
