"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from fieldgauge.operators.batches import assign_batches, eligible
from fieldgauge.operators.ledger import latest_by_key, ledger_view
from fieldgauge.operators.results import per_sensor_results
from fieldgauge.operators.series import _narrowed, nearest_rank, with_spans
from fieldgauge.plans import queries_loads, registry

SF = "/root/testdata/sf0.001"
# These run streams and writes when called; their steps are covered by the rest.
RUNS_JOBS = {"drop_folder_listing", "inbox_stream", "categorized_stream", "redelivered_store", "store_ledger", "store_jobs"}
RUNS_JOBS |= set(queries_loads.QUERIES) - {"partly_failed_job"}


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in RUNS_JOBS])
def test_no_pairing_and_no_python(spark, name):
    plan = physical(registry.QUERIES[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "concat('t', id % 3) AS sensor_type", "double(id) AS value", "string(null) AS category", "'x' AS unit", "'s' AS sensor_id")
    rows.write.partitionBy("sensor_type").parquet(str(tmp_path / "m"))
    measurements = spark.read.parquet(str(tmp_path / "m"))
    plan = physical(eligible(measurements, after_id=10, sensor_types=["t1"]).select("id", "value"))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "sensor_type" in re.search(r"PartitionFilters: \[(.*?)\], Pushed", scan).group(1)
    assert "GreaterThan(id,10)" in scan and "IsNull(category)" in scan
    assert "unit" not in re.search(r"ReadSchema: (.*)", scan).group(1)


def test_latest_row_is_cut_before_the_shuffle(spark):
    events = spark.range(10).selectExpr("id % 2 AS key", "id AS seq")
    assert physical(latest_by_key(events, ["key"], ["seq"])).count("WindowGroupLimit") == 2


def test_results_are_combined_before_the_shuffle(spark):
    rows = spark.range(10).selectExpr("'t' AS sensor_type", "1 AS batch_number", "'s' AS sensor_id", "double(id) AS value", "'LOW' AS category")
    assert "partial_count" in physical(per_sensor_results(rows))


def test_a_type_is_numbered_in_more_than_one_group(spark):
    rows = spark.range(0, 5 << 20, 1 << 10).selectExpr("id", "'hot' AS sensor_type", "'s' AS sensor_id", "1.0D AS value")
    plan = physical(assign_batches(rows, 500))
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("_slice" in line for line in windows)
    assert assign_batches(rows, 500).agg(F.max("batch_number")).first()[0] == 11


def test_files_are_parsed_once_for_their_verdicts(spark):
    plan = physical(registry.QUERIES["file_verdicts"](spark, SF))
    # The stand-in files are made of one scan; lines and items are the two generators of one parse.
    assert len(re.findall(r"Scan parquet", plan)) == 1 and plan.count("Generate posexplode") == 2


def test_the_ledger_is_read_once(spark):
    events = spark.range(10).selectExpr("string(id % 2) AS key", "'r' AS run_id", "id AS seq", "timestamp_seconds(id) AS created_at")
    plan = physical(ledger_view(events, ["seq"]))
    assert plan.count("Range (") == 1 and plan.count("Exchange") == 1


def test_spans_and_bins_are_bounded(spark):
    # One day holds nearly all samples of one run, most of them within an hour.
    samples = spark.range(40_000).selectExpr("'hot' AS run", "CASE WHEN id < 30000 THEN 1000 + id * 0.1 ELSE id * 2.0D END AS t", "id AS total")
    groups = with_spans(samples, "run", "t", rows=500).groupBy("run", "_span").count()
    assert groups.agg(F.max("count")).first()[0] < 500 + 2 * 14 and groups.count() > 50
    # All values within one part in a million of each other.
    close = spark.range(50_000).selectExpr("'g' AS g", "1.0D + id / 5.0e10D AS x")
    plan = physical(nearest_rank(close, ["g"], "x", {"p50": 0.5}))
    assert plan.count("_step1") and plan.count("_step2")
    assert nearest_rank(close, ["g"], "x", {"p50": 0.5}).first()["p50"] == 1.0 + 25_000 / 5.0e10
    keyed = close.selectExpr("g", "'p50' AS _name", "x AS _x", "1L AS _n", "25000L AS _rest", "1.0D AS _lo", "1.0D + 49999 / 5.0e10D AS _hi")
    once = _narrowed(keyed, ["g", "_name"], "_step1")
    assert once.count() < 5


def test_updates_and_totals_read_their_rows_once(spark):
    updated = physical(registry.QUERIES["updated_measurements"](spark, SF))
    assert len(re.findall("Scan parquet", updated)) == 1 and "Exchange hashpartitioning" not in updated
    totals = physical(registry.QUERIES["job_totals"](spark, SF))
    # One numbering: the rows, and the counts of their slices.
    assert len(re.findall("Window \\[row_number", totals)) == 1
