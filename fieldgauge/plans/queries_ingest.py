"""Registered queries of ingestion, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import converted_key, error_report_key
from ..functions.times import instant
from ..operators.ledger import error_reports
from ..operators.rules import converted, row_issues, valid_readings, validate_rows, with_catalog
from ..operators.store import replace_by_key
from ..operators.verdicts import issue_samples, issue_text
from ..sources.drop_files import fetch, parse_csv, parse_json, parse_rows
from ..sources.normalized import read_normalized, write_normalized
from ..session import scratch_path
from . import standins
from .ingest import LoadPlan, plan_load
from .steps import FILE_INGESTION, Definition, Step

# -- Spark --------------------------------------------------------------------------------


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.sensor_files(spark, sf_dir)
    return validate_rows(parse_rows(fetch(files)), instant(standins.AS_OF))


def _plan(spark: SparkSession, sf_dir: str) -> LoadPlan:
    return plan_load(standins.sensor_files(spark, sf_dir), instant(standins.AS_OF))


def _readings(readings: DataFrame) -> DataFrame:
    return readings.select(
        "file_key", "line_number", "sensor_id", "sensor_type", F.unix_micros("timestamp").alias("ts_micros"), "value", "unit"
    )


def file_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch(standins.sensor_files(spark, sf_dir)).drop("content")


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_csv(standins.sensor_files(spark, sf_dir))
    return rows.select("file_key", "line_number", "sensor_id", "sensor_type", F.col("timestamp").alias("ts_text"), "value", "unit", "row_error")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_json(standins.sensor_files(spark, sf_dir))
    return rows.select(
        "file_key", "line_number", "sensor_id", "sensor_type", F.col("timestamp").alias("ts_text"),
        parse_number(F.col("value")).alias("number"), "unit", "row_error",
    )


def validated_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(valid_readings(_validated(spark, sf_dir)))


def row_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_issues(_validated(spark, sf_dir))


def issue_sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = issue_samples(_validated(spark, sf_dir))
    return samples.select(
        "file_key", F.size("issues").alias("kept"), F.element_at("issues", -1)["line_number"].alias("last_line"), issue_text(F.col("issues")).alias("shown")
    )


def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).verdicts.select(
        "file_key", "status", "failed_step", "error_type", "error", "format", "row_count", "invalid_row_count", "stored_count"
    )


# Two sets of tight limits: bytes, rows, and the share of bad rows let pass.
LIMITS = {"few rows": (4600, 99, "0.0"), "some bad rows": (10700, 100_000, "0.015")}


def limited_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts under tight limits: files too large, with too many rows, and with a few bad rows that are let pass."""
    files, out = standins.sensor_files(spark, sf_dir), None
    for limits, (size, rows, ratio) in LIMITS.items():
        validate = Step("ingest.validate", parameters={"maxInvalidRowRatio": ratio, "maxRows": str(rows)})
        steps = (Step("ingest.fetch", parameters={"maxBytes": str(size)}), validate, Step("ingest.store"))
        verdicts = plan_load(files, instant(standins.AS_OF), Definition("file-ingestion", steps)).verdicts.select(
            F.lit(limits).alias("limits"), "file_key", "status", "failed_step", "error_type", "error",
            F.size("completed_steps").alias("completed"), "row_count", "invalid_row_count", "stored_count",
        )
        out = verdicts if out is None else out.unionByName(verdicts)
    return out


def lifecycle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a file's normalized readings and its error report belong."""
    keys = standins.ledger_files(spark, sf_dir).select("key")
    return keys.select("key", converted_key(F.col("key")).alias("converted"), error_report_key(F.col("key")).alias("report"))


def error_report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = error_reports(_plan(spark, sf_dir).verdicts, instant(standins.AS_OF), FILE_INGESTION.name, FILE_INGESTION.version)
    parsed = F.from_json("report", "file STRING, pipeline STRING, failedStep STRING, errorType STRING, error STRING, completedSteps ARRAY<STRING>")
    return reports.select("file_key", parsed.alias("r")).select(
        "file_key", F.col("r.file").alias("file"), F.col("r.pipeline").alias("pipeline"), F.col("r.failedStep").alias("failed_step"),
        F.col("r.errorType").alias("error_type"), F.col("r.error").alias("error"), F.size("r.completedSteps").alias("completed"),
    )


def stored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(_plan(spark, sf_dir).readings)


def normalized_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "normalized")
    write_normalized(_plan(spark, sf_dir).readings, path)
    return _readings(read_normalized(spark, path))


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical value of every raw row whose type and unit are known; NULL for a bad number."""
    rows = standins.raw_rows(spark, sf_dir).select(
        "file_no", "position", F.col("sensor_type").alias("type_text"), F.col("unit").alias("unit_text"), parse_number(F.col("value")).alias("raw")
    )
    joined = with_catalog(rows, F.trim(F.translate("type_text", "\t", " ")), F.col("unit_text"))
    return joined.where(F.col("pre").isNotNull()).select(
        "file_no", "position", F.col("type_name").alias("sensor_type"), F.col("unit_text").alias("unit"), "raw", converted(F.col("raw")).alias("value")
    )


def replaced_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of stored urgent orders delivered again with doubled values replace the old ones."""
    lines = standins.stored_lines(spark, sf_dir).select("file_key", "line_number", "value")
    again = standins.ledger_files(spark, sf_dir).where((F.col("status") == "Stored") & (F.col("o_orderpriority") == "1-URGENT"))
    keys = again.select(F.col("key").alias("file_key"))
    delivered = lines.join(keys.hint("shuffle_hash"), "file_key", "left_semi").withColumn("value", F.col("value") * 2)
    return replace_by_key(lines, delivered, ["file_key"], keys)


QUERIES = {
    "file_fetch": file_fetch,
    "csv_rows": csv_rows,
    "json_rows": json_rows,
    "validated_readings": validated_readings,
    "row_issues": row_issue_list,
    "issue_samples": issue_sample_texts,
    "file_verdicts": file_verdicts,
    "limited_verdicts": limited_verdicts,
    "lifecycle_keys": lifecycle_keys,
    "error_reports": error_report_fields,
    "stored_readings": stored_readings,
    "normalized_roundtrip": normalized_roundtrip,
    "unit_conversion": unit_conversion,
    "replaced_measurements": replaced_measurements,
}

# -- SQL ----------------------------------------------------------------------------------

# The units, bounds and exact messages that the SQL checks.
RAW = """
typed AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) AS cents,
         CASE event_type WHEN 'click' THEN 'temperature' WHEN 'view' THEN 'humidity' WHEN 'purchase' THEN 'pressure'
                         WHEN 'signup' THEN 'vibration' WHEN 'error' THEN 'co2' ELSE '' END AS clean_type
  FROM events),
scaled AS (
  SELECT *,
    CASE clean_type
      WHEN 'temperature' THEN CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'F' ELSE 'K' END
      WHEN 'humidity' THEN CASE event_id % 2 WHEN 0 THEN '%' ELSE 'ratio' END
      WHEN 'pressure' THEN CASE event_id % 4 WHEN 0 THEN 'hPa' WHEN 1 THEN 'Pa' WHEN 2 THEN 'kPa' ELSE 'bar' END
      WHEN 'vibration' THEN CASE event_id % 3 WHEN 0 THEN 'mm/s' WHEN 1 THEN 'm/s' ELSE 'in/s' END
      WHEN 'co2' THEN CASE event_id % 2 WHEN 0 THEN 'ppm' ELSE '%' END ELSE '' END AS clean_unit,
    CASE clean_type
      WHEN 'temperature' THEN CASE event_id % 3 WHEN 0 THEN cents // 5 WHEN 1 THEN cents * 2 // 5 ELSE cents // 5 + 25000 END
      WHEN 'humidity' THEN CASE event_id % 2 WHEN 0 THEN cents // 5 ELSE cents // 500 END
      WHEN 'pressure' THEN CASE event_id % 4 WHEN 0 THEN cents // 10 + 90000 WHEN 1 THEN cents * 10 + 9000000
                                             WHEN 2 THEN cents // 50 + 9000 ELSE cents // 5000 + 90 END
      WHEN 'vibration' THEN CASE event_id % 3 WHEN 0 THEN cents // 10 WHEN 1 THEN cents // 10000 ELSE cents // 100 END
      WHEN 'co2' THEN CASE event_id % 2 WHEN 0 THEN cents * 4 + 30000 ELSE cents // 10000 END ELSE cents END AS scaled_cents,
    CASE WHEN event_id // 100 % 23 = 9 THEN 700 ELSE event_id % 2003 END AS flaw
  FROM typed),
raw AS (
  SELECT event_id // 100 AS file_no, CAST(event_id % 100 AS INTEGER) AS position, flaw,
    event_id // 100 % 10 < 3 AS is_json, event_id // 100 % 37 AS fault,
    'file-' || lpad(CAST(event_id // 100 AS VARCHAR), 6, '0')
      || CASE WHEN event_id // 100 % 37 = 5 THEN '.txt' WHEN event_id // 100 % 10 < 3 THEN '.json' ELSE '.csv' END AS file_key,
    CASE WHEN flaw = 100 THEN ' ' ELSE 's-' || user_id END AS sensor_id,
    CASE WHEN flaw = 200 THEN 'radiation' WHEN event_id % 13 = 0 THEN upper(clean_type)
         WHEN event_id % 17 = 0 THEN chr(9) || clean_type || ' ' ELSE clean_type END AS sensor_type,
    CASE WHEN flaw = 300 THEN 'not-a-date' WHEN flaw = 400 THEN '2999-01-01T00:00:00Z'
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts_text,
    CASE WHEN flaw = 500 THEN '1d' WHEN flaw = 700 THEN '99999999'
         ELSE (scaled_cents // 100) || '.' || lpad(CAST(scaled_cents % 100 AS VARCHAR), 2, '0') END AS value_text,
    CASE WHEN flaw = 600 THEN 'parsec' ELSE clean_unit END AS unit
  FROM scaled)"""

CATALOG = """
types(type_name, canonical, lo, hi) AS (VALUES
  ('temperature', 'C', -90.0::DOUBLE, 150.0::DOUBLE), ('humidity', '%', 0.0, 100.0), ('pressure', 'hPa', 300.0, 1100.0),
  ('vibration', 'mm/s', 0.0, 200.0), ('co2', 'ppm', 0.0, 10000.0)),
units(unit_type, unit_name, pre, mul, div) AS (VALUES
  ('temperature', 'C', 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('temperature', 'F', 32.0, 5.0, 9.0), ('temperature', 'K', 273.15, 1.0, 1.0),
  ('humidity', '%', 0.0, 1.0, 1.0), ('humidity', 'ratio', 0.0, 100.0, 1.0),
  ('pressure', 'hPa', 0.0, 1.0, 1.0), ('pressure', 'Pa', 0.0, 1.0, 100.0), ('pressure', 'kPa', 0.0, 10.0, 1.0), ('pressure', 'bar', 0.0, 1000.0, 1.0),
  ('vibration', 'mm/s', 0.0, 1.0, 1.0), ('vibration', 'm/s', 0.0, 1000.0, 1.0), ('vibration', 'in/s', 0.0, 25.4, 1.0),
  ('co2', 'ppm', 0.0, 1.0, 1.0), ('co2', '%', 0.0, 10000.0, 1.0))"""

NUMBER_TEXT = "regexp_replace(CAST({0} AS VARCHAR), '\\.0$', '')"

CHECKED = f"""
joined AS (
  SELECT r.*, CASE WHEN is_json THEN position + 1 ELSE position + 2 END AS line_number,
         trim(r.sensor_id) AS id, trim(r.sensor_type, chr(9) || ' ') AS type_text, t.type_name, t.canonical, t.lo, t.hi, u.pre,
         try_strptime(ts_text, '%Y-%m-%dT%H:%M:%SZ') AS ts, TRY_CAST(value_text AS DOUBLE) AS num,
         round_even((TRY_CAST(value_text AS DOUBLE) - u.pre) * u.mul / u.div * 10000, 0) / 10000 AS value
  FROM raw r
  LEFT JOIN types t ON lower(trim(r.sensor_type, chr(9) || ' ')) = t.type_name
  LEFT JOIN units u ON u.unit_type = t.type_name AND lower(u.unit_name) = lower(r.unit)
  WHERE fault NOT IN (5, 11, 17, 23, 29)),
checked AS (
  SELECT *, CASE
      WHEN flaw = 800 AND is_json THEN 'Item is not an object'
      WHEN flaw = 800 THEN 'Expected 5 fields, got 6'
      WHEN length(id) NOT BETWEEN 1 AND 64 THEN 'sensor_id is required (max 64 chars)'
      WHEN type_name IS NULL THEN 'Unknown sensor_type ''' || type_text || ''''
      WHEN ts IS NULL THEN 'Invalid timestamp ''' || ts_text || ''''
      WHEN ts > TIMESTAMP '2030-01-02 00:00:00' THEN 'Timestamp ''' || ts_text || ''' is in the future'
      WHEN num IS NULL THEN 'Invalid value ''' || value_text || ''''
      WHEN pre IS NULL THEN 'Unit ''' || unit || ''' not supported for ' || type_name
      WHEN value < lo OR value > hi THEN 'Value ' || {NUMBER_TEXT.format('value')} || canonical || ' outside ['
           || {NUMBER_TEXT.format('lo')} || ', ' || {NUMBER_TEXT.format('hi')} || ']'
    END AS message
  FROM joined)"""

ISSUES = """
ranked AS (
  SELECT file_key, line_number, message, row_number() OVER (PARTITION BY file_key ORDER BY line_number) AS rn
  FROM checked WHERE message IS NOT NULL),
samples AS (
  SELECT file_key, count(*) AS kept, max(line_number) AS last_line,
         string_agg('line ' || line_number || ': ' || message, ' | ' ORDER BY line_number) FILTER (WHERE rn <= 5) AS shown
  FROM ranked WHERE rn <= 50 GROUP BY file_key)"""

VERDICTS = """
per_file AS (
  SELECT file_key, count(*) AS total, count(message) AS bad FROM checked GROUP BY file_key),
all_files AS (SELECT DISTINCT file_key, fault, is_json FROM raw),
verdicts AS (
  SELECT f.file_key,
    CASE WHEN fault = 5 THEN 'Unsupported format ''unknown'''
         WHEN fault = 11 AND is_json THEN 'JSON root must be an array'
         WHEN fault = 11 THEN 'Invalid header ''id;type'', expected ''sensor_id,sensor_type,timestamp,value,unit'''
         WHEN fault = 17 AND is_json THEN 'Invalid JSON'
         WHEN fault = 17 THEN 'Empty file'
         WHEN fault = 23 THEN 'File contains no data row'
         WHEN fault = 29 AND is_json THEN 'Invalid JSON'
         WHEN fault = 29 THEN 'Invalid header ''sensor_id,sensor_type,value'', expected ''sensor_id,sensor_type,timestamp,value,unit''' END AS fatal,
    CASE WHEN p.bad > 0 THEN p.bad || '/' || p.total || ' invalid rows (max ratio 0): ' || s.shown END AS bad_rows,
    CASE WHEN fault = 5 THEN 'unknown' WHEN is_json THEN 'json' ELSE 'csv' END AS format, coalesce(p.total, 0) AS total
  FROM all_files f LEFT JOIN per_file p ON p.file_key = f.file_key LEFT JOIN samples s ON s.file_key = f.file_key)"""

BASE = f"WITH {RAW}, {CATALOG}, {CHECKED}"
FULL = f"{BASE}, {ISSUES}, {VERDICTS}"
READING = "file_key, line_number, id AS sensor_id, type_name AS sensor_type, epoch_us(ts) AS ts_micros, value, canonical AS unit"
STORED = f"""{FULL}
SELECT {READING} FROM checked WHERE message IS NULL
  AND file_key IN (SELECT file_key FROM verdicts WHERE fatal IS NULL AND bad_rows IS NULL)"""

ORACLES = {
    "file_fetch": f"""WITH {RAW},
texts AS (
  SELECT *, CASE
      WHEN is_json AND flaw = 800 THEN '42'
      WHEN is_json THEN '{{"sensorId":"' || sensor_id || '","sensorType":"' || replace(sensor_type, chr(9), '\\t') || '","timestamp":"' || ts_text
           || '","value":' || CASE WHEN flaw = 500 OR position % 2 = 0 THEN '"' || value_text || '"' ELSE value_text END || ',"unit":"' || unit || '"}}'
      ELSE concat_ws(',', sensor_id, sensor_type, ts_text, value_text, unit) || CASE WHEN flaw = 800 THEN ',extra' ELSE '' END END AS text
  FROM raw),
files AS (
  SELECT file_key, any_value(fault) AS fault, any_value(is_json) AS is_json,
         string_agg(text, chr(10) ORDER BY position) AS by_line, string_agg(text, chr(13) || chr(10) ORDER BY position) AS by_crlf,
         string_agg(text, ',' ORDER BY position) AS by_comma, string_agg(text, ',' || chr(10) ORDER BY position) AS by_item
  FROM texts GROUP BY file_key),
contents AS (
  SELECT file_key, fault, is_json, CASE
      WHEN is_json THEN CASE fault WHEN 11 THEN '{{"items":[' || by_comma || ']}}' WHEN 17 THEN '' WHEN 23 THEN '[]' WHEN 29 THEN '[' || by_comma
                                   ELSE '[' || by_item || ']' END
      ELSE CASE fault WHEN 11 THEN 'id;type' || chr(10) || by_line WHEN 17 THEN '' WHEN 23 THEN 'sensor_id,sensor_type,timestamp,value,unit'
                      WHEN 29 THEN 'sensor_id,sensor_type,value' || chr(10) || by_line
                      ELSE ' SENSOR_ID,SENSOR_TYPE,TIMESTAMP,VALUE,UNIT' || chr(13) || chr(10) || by_crlf || chr(13) || chr(10) || chr(13) || chr(10) END
      END AS content
  FROM files)
SELECT file_key, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS checksum,
       CASE WHEN fault = 5 THEN 'unknown' WHEN is_json THEN 'json' ELSE 'csv' END AS format
FROM contents""",
    "csv_rows": f"""WITH {RAW}
SELECT file_key, position + 2 AS line_number, sensor_id, sensor_type, ts_text, value_text AS value, unit,
       CASE WHEN flaw = 800 THEN 'Expected 5 fields, got 6' END AS row_error
FROM raw WHERE NOT is_json AND fault NOT IN (5, 11, 17, 23, 29)""",
    "json_rows": f"""WITH {RAW}
SELECT file_key, position + 1 AS line_number, CASE WHEN flaw <> 800 THEN sensor_id END AS sensor_id,
       CASE WHEN flaw <> 800 THEN sensor_type END AS sensor_type, CASE WHEN flaw <> 800 THEN ts_text END AS ts_text,
       CASE WHEN flaw <> 800 THEN TRY_CAST(value_text AS DOUBLE) END AS number, CASE WHEN flaw <> 800 THEN unit END AS unit,
       CASE WHEN flaw = 800 THEN 'Item is not an object' END AS row_error
FROM raw WHERE is_json AND fault NOT IN (5, 11, 17, 23, 29)""",
    "validated_readings": f"{BASE}\nSELECT {READING} FROM checked WHERE message IS NULL",
    "row_issues": f"{BASE}\nSELECT file_key, line_number, message FROM checked WHERE message IS NOT NULL",
    "issue_samples": f"{BASE}, {ISSUES}\nSELECT file_key, kept, last_line, shown FROM samples",
    "file_verdicts": f"""{FULL}
SELECT file_key, CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN 'Stored' ELSE 'Invalid' END AS status,
       CASE WHEN fatal IS NOT NULL OR bad_rows IS NOT NULL THEN 'ingest.validate' END AS failed_step,
       CASE WHEN fatal IS NOT NULL THEN 'InvalidFile' WHEN bad_rows IS NOT NULL THEN 'InvalidRows' END AS error_type,
       coalesce(fatal, bad_rows) AS error, format,
       CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN total ELSE 0 END AS row_count, 0 AS invalid_row_count,
       CASE WHEN fatal IS NULL AND bad_rows IS NULL THEN total ELSE 0 END AS stored_count
FROM verdicts""",
    "lifecycle_keys": """
WITH k AS (SELECT 'run/' || CASE WHEN o_orderkey % 50 = 7 THEN 'poison-' ELSE '' END || 'file-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '.csv' AS key FROM orders)
SELECT key, 'converted/' || key || '.ndjson' AS converted, 'invalid/' || key || '.error.json' AS report FROM k""",
    "error_reports": f"""{FULL}
SELECT file_key, file_key AS file, 'file-ingestion:v1' AS pipeline, 'ingest.validate' AS failed_step,
       CASE WHEN fatal IS NOT NULL THEN 'InvalidFile' ELSE 'InvalidRows' END AS error_type, coalesce(fatal, bad_rows) AS error, 1 AS completed
FROM verdicts WHERE fatal IS NOT NULL OR bad_rows IS NOT NULL""",
    "stored_readings": STORED,
    "normalized_roundtrip": STORED,
    "unit_conversion": f"""WITH {RAW}, {CATALOG}
SELECT file_no, position, type_name AS sensor_type, unit, TRY_CAST(value_text AS DOUBLE) AS raw,
       round_even((TRY_CAST(value_text AS DOUBLE) - pre) * mul / div * 10000, 0) / 10000 AS value
FROM raw JOIN types ON lower(trim(sensor_type, chr(9) || ' ')) = type_name
     JOIN units ON unit_type = type_name AND lower(unit_name) = lower(unit)""",
    "replaced_measurements": """
WITH keyed AS (
  SELECT 'run/' || CASE WHEN l_orderkey % 50 = 7 THEN 'poison-' ELSE '' END || 'file-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '.csv' AS file_key,
         l_orderkey, l_linenumber AS line_number, l_quantity AS value FROM lineitem)
SELECT file_key, line_number,
       CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
            THEN value * 2 ELSE value END AS value
FROM keyed""",
}

# The verdicts again, with the files' sizes and the tight limits.
ORACLES["limited_verdicts"] = f"""{FULL}, sizes AS (SELECT file_key, size_bytes FROM ({ORACLES["file_fetch"]})),
limits(limits, max_bytes, max_rows, ratio, shown) AS (VALUES {", ".join(f"('{k}', {size}, {rows}, {ratio}::DOUBLE, '{ratio.removesuffix('.0')}')" for k, (size, rows, ratio) in LIMITS.items())}),
judged AS (
  SELECT limits, v.file_key, v.total, coalesce(p.bad, 0) AS bad, CASE WHEN size_bytes > max_bytes THEN 'FileTooLarge' WHEN fatal IS NOT NULL OR v.total > max_rows THEN 'InvalidFile'
      WHEN p.bad > 0 AND p.bad / v.total > ratio THEN 'InvalidRows' END AS error_type,
    CASE WHEN size_bytes > max_bytes THEN 'File is ' || size_bytes || ' bytes, max ' || max_bytes WHEN fatal IS NOT NULL THEN fatal
      WHEN v.total > max_rows THEN 'Too many rows (max ' || max_rows || ')'
      WHEN p.bad > 0 AND p.bad / v.total > ratio THEN replace(bad_rows, '(max ratio 0)', '(max ratio ' || shown || ')') END AS error
  FROM verdicts v JOIN sizes USING (file_key) LEFT JOIN per_file p USING (file_key), limits)
SELECT limits, file_key, CASE WHEN error_type IS NULL THEN 'Stored' ELSE 'Invalid' END AS status,
  CASE WHEN error_type = 'FileTooLarge' THEN 'ingest.fetch' WHEN error_type IS NOT NULL THEN 'ingest.validate' END AS failed_step, error_type, error,
  CASE WHEN error_type = 'FileTooLarge' THEN 0 WHEN error_type IS NOT NULL THEN 1 ELSE 3 END AS completed,
  CASE WHEN error_type IS NULL THEN total ELSE 0 END AS row_count, CASE WHEN error_type IS NULL THEN bad ELSE 0 END AS invalid_row_count,
  CASE WHEN error_type IS NULL THEN total - bad ELSE 0 END AS stored_count
FROM judged"""
