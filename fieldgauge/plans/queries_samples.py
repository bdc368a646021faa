"""Registered queries over sample series, report lines and days, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round4
from ..operators.series import (
    bucket_means,
    bucket_width,
    clean_worker_cpu,
    counter_rates,
    interpolate,
    load_window,
    nearest_rank,
    overall_throughput,
    poll_throughput,
    rolling_delta,
    run_summary,
    sample_window,
)
from ..operators.spine import entity_day_summary
from ..session import scratch_path
from ..sources.samples import largest_tables, parse_report_lines, read_report_lines, read_samples, top_statements
from . import standins

# The span of the events, in seconds and days.
RUN_SECONDS = 30 * 86_400.0
FIRST_DAY, DAYS = "2024-01-01", 30
PERCENTILES = {"p50": 0.50, "p99": 0.99}

# -- Spark --------------------------------------------------------------------------------


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-rate series thinned to at most 500 points."""
    width = bucket_width(RUN_SECONDS)
    series = bucket_means(standins.hourly(spark, sf_dir), "t", width, ["calls", "cents"], ["run"])
    return series.select("run", "t", round4(F.col("calls")).alias("calls"), round4(F.col("cents")).alias("cents"))


def event_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the raw events per run and four-hour bucket."""
    events = standins.event_samples(spark, sf_dir)
    series = bucket_means(events, "t", 14_400, ["cents"], ["run"])
    return series.select("run", "t", round4(F.col("cents")).alias("cents"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = counter_rates(standins.counters(spark, sf_dir), "run", "t", ["calls", "cents"], [("cents", "calls")])
    return result.select("run", "t", *[round4(F.col(c)).alias(c) for c in ("calls_per_s", "cents_per_s", "cents_mean")])


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_delta(standins.counters(spark, sf_dir), "run", "t", "calls")


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles per run and hour."""
    return nearest_rank(standins.event_samples(spark, sf_dir), ["run", "hour"], "cents", PERCENTILES)


def run_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over whole runs: five groups that hold everything."""
    return nearest_rank(standins.event_samples(spark, sf_dir), ["run"], "cents", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each run at the centres of six-hour buckets, also outside its samples."""
    samples = standins.counters(spark, sf_dir)
    runs = samples.select("run").distinct()
    ticks = F.sequence(F.lit(-1), F.lit(int(RUN_SECONDS / 21_600) + 1))
    targets = runs.select("run", F.explode(ticks).alias("i")).select("run", (F.col("i") * 21_600.0 + 10_800.0).alias("t"))
    return interpolate(samples, targets, "run", "t", "calls").select("run", "t", round4(F.col("calls")).alias("calls"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = standins.counters(spark, sf_dir)
    samples = counters.join(standins.hourly(spark, sf_dir).select("run", "t", F.col("calls").alias("rate")), ["run", "t"]).select(
        "run", "t", "calls", F.col("rate").cast("double").alias("rate"), F.col("peak").cast("double").alias("latency"),
        (F.col("rate") * 3).cast("double").alias("inserts"), (F.col("peak") % 7).cast("double").alias("insert_ms"),
        (F.col("peak") % 100).cast("double").alias("cpu"), (F.lit(20.0) + F.col("calls")).alias("size_mb"),
    )
    result = run_summary(samples, "run", "t", "calls", "rate", "latency", "inserts", "insert_ms", ["cpu"], "size_mb")
    doubles = [c for c in result.columns if c not in ("run", "total")]
    return result.select("run", "total", *[round4(F.col(c)).alias(c) for c in doubles])


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the first ten days and a little around, CPU of vanished workers cleared."""
    samples = standins.hourly(spark, sf_dir).select(
        "run", "t", (F.col("peak") - 3000).cast("double").alias("cpu"), F.col("calls").cast("double").alias("memory")
    )
    end = 10 * 86_400.0
    kept = clean_worker_cpu(sample_window(samples, "t", end), "cpu", "memory")
    loaded = load_window(kept, "t", end).groupBy("run").agg(F.count(F.lit(1)).alias("loaded"))
    return kept.groupBy("run").agg(F.count(F.lit(1)).alias("kept"), F.sum("cpu").alias("cpu")).join(loaded, "run")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = poll_throughput(standins.counters(spark, sf_dir), "run", "t", "calls")
    return polls.select("run", "t", F.col("calls").alias("done"), round4(F.col("files_per_hour")).alias("files_per_hour"))


def whole_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = overall_throughput(standins.counters(spark, sf_dir), "run", "t", "calls")
    return overall.select("run", round4(F.col("files_per_hour")).alias("files_per_hour"))


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples written as numeric CSV and read back."""
    path = scratch_path(spark, "samples")
    hourly = standins.hourly(spark, sf_dir).selectExpr("t AS elapsed_s", "double(calls) AS calls", "double(cents) / 100 AS total")
    hourly.write.option("header", "true").csv(path)
    return read_samples(spark, path, ["elapsed_s", "calls", "total"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as lines of a database report, in every shape and in none."""
    return standins.table(spark, sf_dir, "orders").selectExpr(
        """CASE o_orderkey % 5
             WHEN 0 THEN concat('db_size_mb|', o_custkey)
             WHEN 1 THEN concat('table_', lower(substring(o_orderpriority, 3, 3)), '|', o_orderkey, '|', o_custkey, ' ',
                                element_at(array('bytes', 'kB', 'MB', 'GB', 'XB'), int(o_custkey % 5) + 1))
             WHEN 2 THEN concat(o_custkey, '.5|', o_orderkey % 1000, '|SELECT ', o_orderkey)
             WHEN 3 THEN concat('Table_', o_custkey, '|', o_orderkey, '|1 MB')
             ELSE concat('note about ', o_orderkey) END AS value"""
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    _lines(spark, sf_dir).write.text(path)
    return read_report_lines(spark, path)


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_tables(parse_report_lines(_lines(spark, sf_dir)))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_statements(parse_report_lines(_lines(spark, sf_dir)))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and measurements of every user on every day; an event type counts as a file."""
    events = standins.table(spark, sf_dir, "events")
    facts = events.select("user_id", "ts", "event_type")
    days = entity_day_summary(facts, events.select("user_id").distinct(), "user_id", "ts", "event_type", FIRST_DAY, DAYS)
    return days.withColumn("day", F.col("day").cast("string"))


QUERIES = {
    "bucket_means": means,
    "event_bucket_means": event_means,
    "counter_rates": rates,
    "rolling_delta": deltas,
    "latency_percentiles": percentiles,
    "run_percentiles": run_percentiles,
    "interpolated_progress": interpolated,
    "run_summary": summary,
    "sample_window": windowed,
    "poll_throughput": throughput,
    "overall_throughput": whole_throughput,
    "sample_files": sample_files,
    "report_lines": report_lines,
    "largest_tables": table_sizes,
    "top_statements": statements,
    "entity_day_summary": user_days,
}

# -- SQL ----------------------------------------------------------------------------------

EVENTS = """timed AS (
  SELECT event_type AS run, CAST(round(value * 100) AS BIGINT) AS cents, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS t,
         CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS hour FROM events)"""
HOURLY = f"""{EVENTS},
hourly AS (
  SELECT run, CAST(hour * 3600 + 1800 AS DOUBLE) AS t, count(*) AS calls, CAST(sum(cents) AS BIGINT) AS cents, max(cents) AS peak
  FROM timed GROUP BY run, hour)"""
COUNTERS = f"""{HOURLY},
counters AS (
  SELECT run, t, calls AS rate, peak, CAST(sum(calls) OVER w AS BIGINT) AS calls, CAST(sum(cents) OVER w AS BIGINT) AS cents
  FROM hourly WINDOW w AS (PARTITION BY run ORDER BY t)),
lagged AS (SELECT *, lag(t) OVER w AS pt, lag(calls) OVER w AS pcalls, lag(cents) OVER w AS pcents FROM counters WINDOW w AS (PARTITION BY run ORDER BY t))"""
R4 = "round_even(({0}) * 10000, 0) / 10000"
RANKED = f"""{EVENTS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {{0}} ORDER BY cents) - 1 AS i, count(*) OVER (PARTITION BY {{0}}) AS n FROM timed)"""
NTH = "max(cents) FILTER (WHERE i = least(n - 1, CAST(floor({0} * n) AS BIGINT))) AS {1}"
LINES = """lines AS (
  SELECT CASE o_orderkey % 5
      WHEN 0 THEN 'db_size_mb|' || o_custkey
      WHEN 1 THEN 'table_' || lower(substring(o_orderpriority, 3, 3)) || '|' || o_orderkey || '|' || o_custkey || ' '
                  || CASE o_custkey % 5 WHEN 0 THEN 'bytes' WHEN 1 THEN 'kB' WHEN 2 THEN 'MB' WHEN 3 THEN 'GB' ELSE 'XB' END
      WHEN 2 THEN o_custkey || '.5|' || (o_orderkey % 1000) || '|SELECT ' || o_orderkey
      WHEN 3 THEN 'Table_' || o_custkey || '|' || o_orderkey || '|1 MB'
      ELSE 'note about ' || o_orderkey END AS value FROM orders),
parts AS (SELECT split_part(value, '|', 1) AS a, split_part(value, '|', 2) AS b, split_part(value, '|', 3) AS c, len(string_split(value, '|')) AS n FROM lines),
kinds AS (
  SELECT *, CASE WHEN a = 'db_size_mb' THEN 'size' WHEN n = 3 AND regexp_matches(a, '^[a-z_]+$') AND regexp_matches(b, '^[0-9]+$') THEN 'table'
                 WHEN n = 3 AND regexp_matches(a, '^[0-9.]+$') THEN 'statement' END AS kind,
         CAST(split_part(c, ' ', 1) AS VARCHAR) AS amount, split_part(c, ' ', 2) AS unit FROM parts),
parsed AS (
  SELECT kind, CASE WHEN kind = 'size' THEN CAST(b AS DOUBLE) END AS db_size_mb, CASE WHEN kind = 'table' THEN a END AS table_name,
         CASE WHEN kind = 'table' THEN CAST(b AS BIGINT) END AS row_count, CASE WHEN kind = 'table' THEN c END AS size_text,
         CASE WHEN kind = 'table' THEN CAST(amount AS DOUBLE) * CASE unit WHEN 'kB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END END
           AS size_bytes,
         CASE WHEN kind = 'statement' THEN CAST(a AS DOUBLE) END AS mean_ms, CASE WHEN kind = 'statement' THEN CAST(b AS BIGINT) END AS calls,
         CASE WHEN kind = 'statement' THEN c END AS query_text FROM kinds WHERE kind IS NOT NULL)"""

ORACLES = {
    "bucket_means": f"""WITH {HOURLY}
SELECT run, (floor(t / 5184) + 0.5) * 5184 AS t, {R4.format('avg(calls)')} AS calls, {R4.format('avg(cents)')} AS cents
FROM hourly GROUP BY run, floor(t / 5184)""",
    "event_bucket_means": f"""WITH {EVENTS}
SELECT run, (floor(t / 14400) + 0.5) * 14400 AS t, {R4.format('avg(cents)')} AS cents FROM timed GROUP BY run, floor(t / 14400)""",
    "counter_rates": f"""WITH {COUNTERS}
SELECT run, t, {R4.format('(calls - pcalls) / (t - pt)')} AS calls_per_s, {R4.format('(cents - pcents) / (t - pt)')} AS cents_per_s,
       CASE WHEN calls > pcalls THEN {R4.format('(cents - pcents) / (calls - pcalls)')} ELSE 0 END AS cents_mean
FROM lagged WHERE pt IS NOT NULL""",
    "rolling_delta": f"WITH {COUNTERS}\nSELECT run, t, calls - coalesce(pcalls, 0) AS calls_delta FROM lagged",
    "latency_percentiles": f"""WITH {RANKED.format('run, hour')}
SELECT run, hour, count(*) AS n, {NTH.format('0.5::DOUBLE', 'p50')}, {NTH.format('0.99::DOUBLE', 'p99')}, max(cents) AS max FROM ranked GROUP BY run, hour""",
    "run_percentiles": f"""WITH {RANKED.format('run')}
SELECT run, count(*) AS n, {NTH.format('0.1::DOUBLE', 'p10')}, {NTH.format('0.5::DOUBLE', 'p50')}, {NTH.format('0.9::DOUBLE', 'p90')},
       {NTH.format('0.99::DOUBLE', 'p99')}, max(cents) AS max FROM ranked GROUP BY run""",
    "interpolated_progress": f"""WITH {COUNTERS},
targets AS (SELECT run, i * 21600.0::DOUBLE + 10800 AS t FROM (SELECT DISTINCT run FROM counters), (SELECT unnest(range(-1, 122)) AS i)),
around AS (
  SELECT g.run, g.t, max(c.t) FILTER (WHERE c.t < g.t) AS t1, min(c.t) FILTER (WHERE c.t >= g.t) AS t2
  FROM targets g JOIN counters c ON c.run = g.run GROUP BY g.run, g.t)
SELECT a.run, a.t, {R4.format('''CASE WHEN a.t <= 0 THEN 0.0::DOUBLE WHEN t2 IS NULL THEN p.calls WHEN t1 IS NULL THEN n.calls * a.t / t2
    ELSE p.calls + (n.calls - p.calls) * (a.t - t1) / (t2 - t1) END''')} AS calls
FROM around a LEFT JOIN counters p ON p.run = a.run AND p.t = t1 LEFT JOIN counters n ON n.run = a.run AND n.t = t2""",
    "run_summary": f"""WITH {COUNTERS},
s AS (SELECT run, max(calls) AS total, max(t) AS elapsed_s, sum(rate * peak) / greatest(1, sum(rate)) AS latency_mean, max(peak) AS latency_max,
             sum(rate * 3) AS loads, sum(rate * 3 * (peak % 7)) / sum(rate * 3) AS load_ms_mean, avg(peak % 100) AS cpu_avg, max(peak % 100) AS cpu_max,
             20.0::DOUBLE + max(calls) AS size_mb FROM counters GROUP BY run)
SELECT run, total, elapsed_s, {R4.format('total / elapsed_s')} AS rate, {R4.format('latency_mean')} AS latency_mean, CAST(latency_max AS DOUBLE) AS latency_max,
       {R4.format('loads / total')} AS loads_per_unit, {R4.format('load_ms_mean')} AS load_ms_mean, {R4.format('cpu_avg')} AS cpu_avg,
       CAST(cpu_max AS DOUBLE) AS cpu_max, size_mb, {R4.format('(size_mb - 18) * 1024 / total')} AS kb_per_unit,
       {R4.format('547500.0::DOUBLE / (total / elapsed_s)')} AS eta_s
FROM s""",
    "sample_window": f"""WITH {HOURLY}
SELECT run, count(*) AS kept, CAST(sum(CASE WHEN peak < 3000 OR calls <= 0 THEN 0 ELSE peak - 3000 END) AS DOUBLE) AS cpu,
       count(*) FILTER (WHERE t BETWEEN 0 AND 864000) AS loaded
FROM hourly WHERE t BETWEEN -5 AND 864020 GROUP BY run""",
    "poll_throughput": f"""WITH {COUNTERS}
SELECT run, t, calls AS done, {R4.format('(calls - coalesce(pcalls, 0)) / greatest(1e-6, t - coalesce(pt, 0)) * 3600')} AS files_per_hour FROM lagged""",
    "overall_throughput": f"WITH {COUNTERS}\nSELECT run, {R4.format('max(calls) / max(t) * 3600')} AS files_per_hour FROM counters GROUP BY run",
    "sample_files": f"WITH {HOURLY}\nSELECT t AS elapsed_s, CAST(calls AS DOUBLE) AS calls, CAST(cents AS DOUBLE) / 100 AS total FROM hourly",
    "report_lines": f"WITH {LINES}\nSELECT * FROM parsed",
    "largest_tables": f"WITH {LINES}\nSELECT table_name, row_count, size_text, size_bytes FROM parsed WHERE kind = 'table'",
    "top_statements": f"""WITH {LINES}
SELECT mean_ms, calls, query_text, mean_ms * calls AS total_ms FROM parsed WHERE kind = 'statement' ORDER BY total_ms DESC, query_text LIMIT 12""",
    "entity_day_summary": """
WITH users AS (SELECT DISTINCT user_id FROM events),
days AS (SELECT CAST(DATE '2024-01-01' + CAST(unnest(range(0, 30)) AS INTEGER) AS DATE) AS day)
SELECT u.user_id, CAST(d.day AS VARCHAR) AS day, count(DISTINCT e.event_type) AS files, count(e.event_id) AS measurements
FROM users u CROSS JOIN days d LEFT JOIN events e ON e.user_id = u.user_id AND CAST(e.ts AS DATE) = d.day
GROUP BY u.user_id, d.day""",
}
