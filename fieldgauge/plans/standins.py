"""Reference-shaped tables built from the given parquet tables.

events become measurements, raw sensor files and samples; orders become the file ledger,
the object listing and versioned rows; lineitem becomes the stored lines of a file.
Everything is derived by Spark, so it grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.catalog import fixed_table
from ..functions.text import zero_padded
from ..session import configure
from ..sources.drop_files import CSV_HEADER

# A file holds this many consecutive events, so no file grows with the data.
FILE_EVENTS = 100
AS_OF = "2030-01-01 00:00:00"
EPOCH = "2024-01-01 00:00:00"
RUN_PREFIX = "run"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- measurements -------------------------------------------------------------------------


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measurements that were never categorized."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("sensor_type"),
        F.col("user_id").alias("sensor_id"),
        F.col("value"),
    )


def known_measurements(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """The same with categories from before: of other jobs, and of this one's earlier attempt."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    earlier = k < 20
    own = (k >= 20) & (k < 30)
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("sensor_type"),
        F.col("user_id").alias("sensor_id"),
        F.col("value"),
        F.when(earlier | own, "NORMAL").alias("category"),
        F.when(earlier, "before").when(own, F.concat(F.lit(f"{base}-"), F.col("event_type"))).alias("categorized_by_job"),
    )


# -- raw sensor files ---------------------------------------------------------------------


# Sensor type per event type, and per unit the terms of cents * mul div by + plus.
RAW_UNITS = {
    "click": ("temperature", [("C", 1, 5, 0), ("F", 2, 5, 0), ("K", 1, 5, 25_000)]),
    "view": ("humidity", [("%", 1, 5, 0), ("ratio", 1, 500, 0)]),
    "purchase": ("pressure", [("hPa", 1, 10, 90_000), ("Pa", 10, 1, 9_000_000), ("kPa", 1, 50, 9_000), ("bar", 1, 5_000, 90)]),
    "signup": ("vibration", [("mm/s", 1, 10, 0), ("m/s", 1, 10_000, 0), ("in/s", 1, 100, 0)]),
    "error": ("co2", [("ppm", 4, 1, 30_000), ("%", 1, 10_000, 0)]),
}
# The least number that all counts of units divide.
TURNS = 12


def raw_units(spark: SparkSession) -> DataFrame:
    """Unit of an event by its type and number: 60 fixed rows."""
    rows = [
        (event_type, turn, sensor_type, *units[turn % len(units)])
        for event_type, (sensor_type, units) in RAW_UNITS.items()
        for turn in range(TURNS)
    ]
    return fixed_table(spark, rows, ["event_type", "turn", "type_name", "unit_name", "mul", "by", "plus"])


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw rows of sensor files, with some flaws.

    Units, spellings and flaws go by the event's number; every event is a row.
    """
    events = table(spark, sf_dir, "events").withColumn("turn", F.expr(f"int(event_id % {TURNS})"))
    return (
        events.join(F.broadcast(raw_units(spark)), ["event_type", "turn"])
        .selectExpr(
            "event_id", "user_id", "ts", "type_name", "unit_name",
            "bigint(round(value * 100)) * mul div by + plus AS cents",
            f"event_id div {FILE_EVENTS} AS file_no",
            f"CASE WHEN event_id div {FILE_EVENTS} % 23 = 9 THEN 700 ELSE event_id % 2003 END AS flaw",
        )
        .selectExpr(
            "file_no",
            f"int(event_id % {FILE_EVENTS}) AS position",
            "flaw",
            "CASE WHEN flaw = 100 THEN ' ' ELSE concat('s-', user_id) END AS sensor_id",
            """CASE WHEN flaw = 200 THEN 'radiation' WHEN event_id % 13 = 0 THEN upper(type_name)
                    WHEN event_id % 17 = 0 THEN concat('\\t', type_name, ' ') ELSE type_name END AS sensor_type""",
            """CASE WHEN flaw = 300 THEN 'not-a-date' WHEN flaw = 400 THEN '2999-01-01T00:00:00Z'
                    ELSE concat(replace(substring(string(ts), 1, 19), ' ', 'T'), 'Z') END AS timestamp""",
            """CASE WHEN flaw = 500 THEN '1d' WHEN flaw = 700 THEN '99999999'
                    ELSE concat(cents div 100, '.', lpad(string(cents % 100), 2, '0')) END AS value""",
            "CASE WHEN flaw = 600 THEN 'parsec' ELSE unit_name END AS unit",
        )
    )


def sensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows written into files: (file_key, size_bytes, content).

    A file collects at most FILE_EVENTS rows. Some files are broken as a whole.
    """
    header = ",".join(CSV_HEADER)
    rows = raw_rows(spark, sf_dir).selectExpr(
        "file_no",
        "position",
        f"""CASE WHEN file_no % 10 < 3 AND flaw = 800 THEN '42'
                 WHEN file_no % 10 < 3 THEN concat(
                   '{{"sensorId":"', sensor_id, '","sensorType":"', replace(sensor_type, '\\t', '\\\\t'), '","timestamp":"', timestamp, '","value":',
                   CASE WHEN flaw = 500 OR position % 2 = 0 THEN concat('"', value, '"') ELSE value END, ',"unit":"', unit, '"}}')
                 ELSE concat(concat_ws(',', {header}), CASE WHEN flaw = 800 THEN ',extra' ELSE '' END) END AS text""",
    )
    lines = F.sort_array(F.collect_list(F.struct("position", "text"))).alias("lines")
    files = rows.groupBy("file_no").agg(lines).selectExpr("file_no", "file_no % 10 < 3 AS is_json", "file_no % 37 AS fault", "lines.text AS texts")
    return files.selectExpr(
        """concat(format_string('file-%06d', file_no),
                  CASE WHEN fault = 5 THEN '.txt' WHEN is_json THEN '.json' ELSE '.csv' END) AS file_key""",
        f"""binary(CASE
              WHEN fault = 17 THEN ''
              WHEN is_json AND fault = 11 THEN concat('{{"items":[', array_join(texts, ','), ']}}')
              WHEN is_json AND fault = 23 THEN '[]'
              WHEN is_json AND fault = 29 THEN concat('[', array_join(texts, ','))
              WHEN is_json THEN concat('[', array_join(texts, ',\\n'), ']')
              WHEN fault = 11 THEN concat('id;type\\n', array_join(texts, '\\n'))
              WHEN fault = 23 THEN '{header}'
              WHEN fault = 29 THEN concat('sensor_id,sensor_type,value\\n', array_join(texts, '\\n'))
              ELSE concat(' {header.upper()}\\r\\n', array_join(texts, '\\r\\n'), '\\r\\n\\r\\n') END) AS content""",
    ).selectExpr("file_key", "bigint(octet_length(content)) AS size_bytes", "content")


# -- ledger, objects, versions ------------------------------------------------------------


def run_key(number: Column) -> Column:
    """Key of an order's file; every fiftieth is marked poison."""
    mark = F.when(number % 50 == 7, "poison-").otherwise("")
    return F.concat(F.lit(f"{RUN_PREFIX}/"), mark, F.lit("file-"), zero_padded(number, 9), F.lit(".csv"))


def ledger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the current ledger rows."""
    status = F.when(F.col("o_orderstatus") == "F", "Stored").when(F.col("o_orderstatus") == "O", "Processing").otherwise("Invalid")
    error = F.when(
        F.col("o_orderstatus") == "P",
        F.when(F.col("o_orderpriority") == "1-URGENT", "IOException: disk gone").otherwise("InvalidRows: 1/4 invalid rows"),
    )
    return table(spark, sf_dir, "orders").select(
        run_key(F.col("o_orderkey")).alias("key"),
        status.alias("status"),
        error.alias("error"),
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("stored_count"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        "o_orderpriority",
    )


def ledger_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as events of a ledger: each customer is a file, each order one event about it."""
    status = F.when(F.col("o_orderstatus") == "F", "Stored").when(F.col("o_orderstatus") == "O", "Processing").otherwise("Invalid")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("file-"), zero_padded(F.col("o_custkey"), 9), F.lit(".csv")).alias("key"),
        status.alias("status"),
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderkey").alias("seq"),
    )


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as stored measurements of the orders' files; some not categorized yet."""
    return table(spark, sf_dir, "lineitem").select(
        run_key(F.col("l_orderkey")).alias("file_key"),
        F.col("l_linenumber").alias("line_number"),
        F.when(F.col("l_returnflag") != "A", "NORMAL").alias("category"),
        F.col("l_linestatus").alias("sensor_type"),
        F.col("l_quantity").alias("value"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as an object listing over the life-cycle prefixes, with error reports."""
    orders = table(spark, sf_dir, "orders")
    waiting = F.when(F.col("o_custkey") % 2 == 0, "incoming/").otherwise("processing/")
    prefix = F.when(F.col("o_orderstatus") == "F", "processed/").when(F.col("o_orderstatus") == "O", waiting).otherwise("invalid/")
    placed = orders.select(
        F.concat(prefix, run_key(F.col("o_orderkey"))).alias("key"),
        F.col("o_totalprice").cast("bigint").alias("size"),
        F.col("o_orderdate").cast("timestamp").alias("last_modified"),
        (F.col("o_orderstatus") == "P").alias("_rejected"),
    )
    names = F.when(F.col("_rejected"), F.array("key", F.concat("key", F.lit(".error.json")))).otherwise(F.array("key"))
    return placed.select(F.explode(names).alias("key"), "size", "last_modified")


def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files being worked on: open urgent orders."""
    working = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").where(working).select(run_key(F.col("o_orderkey")).alias("key"))


def versioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as versions of their customer; order numbers rise, so they serve as versions."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("comment"), "o_orderstatus"
    )


# -- samples ------------------------------------------------------------------------------


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as single samples: run (event type), t in seconds, hour, value in cents."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_seconds(F.lit(EPOCH).cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        seconds.alias("t"),
        F.floor(seconds / 3600).alias("hour"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one sample per run and hour: count, sum and peak in cents."""
    return (
        event_samples(spark, sf_dir)
        .groupBy("run", "hour")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("cents").alias("cents"), F.max("cents").alias("peak"))
        .select("run", (F.col("hour") * 3600 + 1800).cast("double").alias("t"), "calls", "cents", "peak")
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly samples as running counters.

    One row per hour and type: the window grows with the calendar, not with the events.
    """
    upto = Window.partitionBy("run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return hourly(spark, sf_dir).select(
        "run", "t", F.sum("calls").over(upto).alias("calls"), F.sum("cents").over(upto).alias("cents"), "peak"
    )
