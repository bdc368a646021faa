"""Replacing by key without sorting what stays."""

from fieldgauge.plans.queries_ingest import replaced_measurements


def test_rows_are_not_sorted_by_key(spark):
    plan = replaced_measurements(spark, "/root/testdata/sf0.01")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
