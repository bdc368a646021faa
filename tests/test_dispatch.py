import random

import pytest

from fieldgauge.functions.times import instant
from fieldgauge.operators.dispatch import dispatch_counts, dispatch_plan, dispatched, orphans
from fieldgauge.operators.reports import file_status, list_files, list_results
from fieldgauge.operators.versions import append_version, get_version, latest_versions, next_versions


def by_hand(keys, running, max_files, max_in_flight):
    budget = max(0, min(max_in_flight - len(running), max_files)) if max_in_flight else max_files
    listed, states, started = sorted(keys), {}, 0
    for key in listed[:max_files]:
        if started >= budget:
            states[key] = "throttled"
        elif key in running:
            states[key] = "already_running"
        else:
            states[key], started = "dispatched", started + 1
    throttled = sum(s == "throttled" for s in states.values())
    return states, len(listed) > max_files and started > 0 and throttled == 0


@pytest.mark.parametrize("max_files, max_in_flight", [(2000, 0), (10, 0), (10, 18), (10, 15), (30, 22), (10, 5), (40, 0)])
def test_dispatch_plan(spark, max_files, max_in_flight):
    chance = random.Random(max_files + max_in_flight)
    keys = [f"k{i:03}" for i in chance.sample(range(500), 40)]
    running = set(chance.sample(keys, 12)) | {"elsewhere-1", "elsewhere-2"}
    listing = spark.createDataFrame([(f"incoming/{k}",) for k in keys], "key string").repartition(3)
    plan = dispatch_plan(listing, spark.createDataFrame([(k,) for k in running], "key string"), max_files, max_in_flight)
    states, more = by_hand(keys, running, max_files, max_in_flight)
    assert {r["key"].removeprefix("incoming/"): r["state"] for r in plan.collect() if r["state"] != "beyond"} == states
    counts = dispatch_counts(plan).first()
    tally = lambda s: sum(v == s for v in states.values())
    assert tuple(counts) == (len(states), tally("dispatched"), tally("already_running"), tally("throttled"), more)
    assert dispatched(plan).count() == tally("dispatched")


def test_orphans(spark):
    rows = [("processing/a", "2026-01-01 00:00:00"), ("processing/b", "2026-01-01 00:00:00"), ("processing/c", "2026-01-01 00:50:00"), ("incoming/d", "2026-01-01 00:00:00")]
    listing = spark.createDataFrame(rows, "key string, ts string").selectExpr("key", "timestamp(ts) AS last_modified")
    running = spark.createDataFrame([("b",)], "key string")
    assert [r["key"] for r in orphans(listing, running, 30, instant("2026-01-01 01:00:00")).collect()] == ["a"]


def test_listing_limits(spark):
    files = spark.range(1500).selectExpr("concat('f', id) AS key", "IF(id % 2 = 0, 'Stored', 'Invalid') AS status", "timestamp_seconds(id) AS updated_at")
    assert list_files(files, take=9999).count() == 1000 and list_files(files, take=0).count() == 1
    assert [r["key"] for r in list_files(files, "Invalid", 2).collect()] == ["f1499", "f1497"]
    results = spark.range(20).selectExpr("'j' AS job_id", "int(20 - id) AS batch_number", "string(id) AS sensor_id")
    assert [r["batch_number"] for r in list_results(results, "j", 3).collect()] == [1, 2, 3]


def test_file_status_tolerates_missing_parts(spark):
    files = spark.createDataFrame([("a", "Stored")], "key string, status string")
    listing = spark.createDataFrame([("processed/a", {"rows": "1"}), ("invalid/a", {}), ("incoming/b", {})], "key string, tags map<string,string>")
    row = file_status(files, listing, "incoming/a").first()
    assert row["status"] == "Stored" and row["objects"] == {"processed/a": {"rows": "1"}, "invalid/a": {}}
    assert file_status(files, listing, "b").first()["objects"] == {"incoming/b": {}}
    assert file_status(files, listing.where("false")).first()["objects"] is None


def test_versions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, version int, body string")
    assert sorted(map(tuple, latest_versions(rows).collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert get_version(rows, "a").first()["body"] == "y" and get_version(rows, "a", 1).first()["body"] == "x"
    new = spark.createDataFrame([("a", "n1", 1), ("a", "n2", 2), ("c", "n3", 1)], "name string, body string, seq int")
    assert sorted((r["name"], r["version"], r["body"]) for r in append_version(rows, new, order="seq").collect()) == [("a", 3, "n1"), ("a", 4, "n2"), ("c", 1, "n3")]
    assert sorted(map(tuple, next_versions(rows, new).collect())) == [("a", 3), ("c", 1)]
