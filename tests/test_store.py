import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fieldgauge.functions.times import instant
from fieldgauge.operators.audit import audit
from fieldgauge.operators.ledger import error_reports, finalized_state, ledger_view
from fieldgauge.operators.store import LateWriter, SensorStore, replace_by_key
from fieldgauge.plans.ingest import folder_files, ingest_folder, ingest_load, plan_load, reingest, sweep, with_ids
from fieldgauge.plans.process import categorize_loads, categorize_missed
from fieldgauge.plans.steps import Definition, SENSOR_PROCESSING, Step, StepFailed
from fieldgauge.sources.listing import count_by_prefix, empty_objects, list_objects, listing_page, scan_folder
from fieldgauge.sources.normalized import read_normalized, write_normalized
from fieldgauge.streaming.categorizer import categorize_stream
from fieldgauge.streaming.inbox import check_interval, ingest_stream, sweep_due, sweep_stream

HEADER = "sensor_id,sensor_type,timestamp,value,unit\n"
AS_OF = datetime(2030, 1, 1, tzinfo=timezone.utc)


def csv(*values, kind="co2", unit="ppm", sensor="s-1"):
    return HEADER + "".join(f"{sensor},{kind},2026-01-01T00:00:00Z,{v},{unit}\n" for v in values)


def live(store):
    return sorted((r["file_key"], r["line_number"], r["value"]) for r in store.measurements().collect())


@pytest.fixture
def store(spark, tmp_path):
    return SensorStore(spark, str(tmp_path / "store"))


def test_redelivery_replaces_rows(store, drop):
    drop("a.csv", csv(1, 2, 3))
    drop("b.csv", csv(7))
    assert ingest_folder(store, drop.inbox, "one", as_of=AS_OF) == 1
    assert live(store) == [("a.csv", 2, 1.0), ("a.csv", 3, 2.0), ("a.csv", 4, 3.0), ("b.csv", 2, 7.0)]
    drop("a.csv", csv(9))
    assert reingest(store, drop.inbox, ["a.csv"], "two", as_of=AS_OF) == 2
    assert live(store) == [("a.csv", 2, 9.0), ("b.csv", 2, 7.0)]
    row = {r["key"]: r for r in store.files().collect()}
    assert (row["a.csv"]["attempts"], row["b.csv"]["attempts"]) == (2, 1)
    assert live(store.compact(store.root + "-compact")) == live(store)


def test_rejected_redelivery_withdraws_rows(store, drop):
    drop("a.csv", csv(1))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    drop("a.csv", "")
    reingest(store, drop.inbox, ["a.csv"], "emptied", as_of=AS_OF)
    assert live(store) == [] and store.files().first()["error"] == "InvalidFile: Empty file"
    drop("a.csv", csv(-1))
    reingest(store, drop.inbox, ["a.csv"], "two", as_of=AS_OF)
    assert live(store) == []
    row = store.files().first()
    assert (row["status"], row["stored_count"], row["failed_step"]) == ("Invalid", 0, "ingest.validate")
    assert row["error"] == "InvalidRows: 1/1 invalid rows (max ratio 0): line 2: Value -1ppm outside [0, 10000]"
    report = store.reports().where("load = 3").select(F.get_json_object("report", "$.errorType"), F.get_json_object("report", "$.completedSteps")).first()
    assert tuple(report) == ("InvalidRows", '["ingest.fetch"]')


def test_repeated_source_is_ignored(store, drop):
    drop("a.csv", csv(1))
    assert ingest_folder(store, drop.inbox, "one", as_of=AS_OF) == 1
    drop("b.csv", csv(2))
    assert ingest_folder(store, drop.inbox, "one", as_of=AS_OF) is None
    assert len(live(store)) == 1


def test_load_cut_short_is_invisible_and_replaced(spark, store, drop):
    drop("a.csv", csv(1))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    drop("b.csv", csv(2, kind="humidity", unit="%"))
    files = folder_files(spark, drop.inbox)
    half = plan_load(files.drop("path"), instant("2030-01-01"))
    claim = store.claim("half", files.select(F.col("file_key").alias("key"), "path"), instant("2030-01-01"))
    store.write_load(claim.load, with_ids(half.readings, half.verdicts, store.next_id())[0])
    assert live(store) == [("a.csv", 2, 1.0)]
    drop("c.csv", csv(3))
    assert reingest(store, drop.inbox, ["c.csv"], "other", as_of=AS_OF) == claim.load + 1
    assert live(store) == [("a.csv", 2, 1.0), ("c.csv", 2, 3.0)]


def test_ids_are_unique_and_follow_loads(spark, store, drop):
    for i in range(6):
        drop(f"f{i}.csv", csv(*range(20)))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    reingest(store, drop.inbox, ["f1.csv"], "two", as_of=AS_OF)
    rows = store.loads().select("id", "load").collect()
    assert len({r["id"] for r in rows}) == len(rows) == 140 and all(r["id"] > 0 for r in rows)
    assert min(r["id"] for r in rows if r["load"] == 2) > max(r["id"] for r in rows if r["load"] == 1)
    store._next_load = (1 << 20) + 5
    drop("late.csv", csv(1))
    assert reingest(store, drop.inbox, ["late.csv"], "three", as_of=AS_OF) == (1 << 20) + 5
    assert store.loads(1 << 20).first()["id"] > max(r["id"] for r in rows)


def test_replace_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    new = spark.createDataFrame([("a", 9)], "k string, n int")
    both = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sorted(map(tuple, replace_by_key(old, new, ["k"]).collect())) == [("a", 9), ("b", 1)]
    assert sorted(map(tuple, replace_by_key(old, new, ["k"], both).collect())) == [("a", 9)]


def test_normalized_round_trip(spark, drop, tmp_path):
    drop("a.csv", csv("68", kind="temperature", unit="F"))
    readings = plan_load(folder_files(spark, drop.inbox), instant("2030-01-01")).readings
    for _ in range(2):
        write_normalized(readings, str(tmp_path / "n"))
    back = read_normalized(spark, str(tmp_path / "n"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in readings.select(*back.columns).collect()]


def test_listing(spark, drop):
    drop("incoming/b.csv", "x")
    drop("incoming/a/c d+e.csv", "xyz")
    drop("incoming/.tmp-1", "x")
    drop("processed/p.csv", "xx")
    drop("invalid/q.csv", "x")
    drop("invalid/q.csv.error.json", "{}")
    drop("incoming/empty +1.csv", "")
    listing = list_objects(spark, drop.inbox)
    assert sorted((r["key"], r["size"]) for r in listing.collect()) == [
        ("incoming/a/c d+e.csv", 3), ("incoming/b.csv", 1), ("invalid/q.csv", 1), ("invalid/q.csv.error.json", 2), ("processed/p.csv", 2)]
    assert [r["key"] for r in empty_objects(scan_folder(spark, drop.inbox), drop.inbox).collect()] == ["incoming/empty +1.csv"]
    assert {r["prefix"]: r["objects"] for r in count_by_prefix(listing).collect()} == {"incoming/": 2, "processing/": 0, "processed/": 1, "invalid/": 1, "converted/": 0}
    assert [r["key"] for r in listing_page(listing, 2, "incoming/a/c d+e.csv").collect()] == ["incoming/b.csv", "invalid/q.csv"]
    keys = spark.createDataFrame([("b.csv",), ("p.csv",), ("q.csv",), ("z.csv",)], "key string")
    assert {r["key"]: r["finalized_as"] for r in finalized_state(keys, listing).collect()} == {"b.csv": "waiting", "p.csv": "processed", "q.csv": "invalid", "z.csv": "missing"}


def test_ledger_view_counts_distinct_runs(spark):
    rows = [("a", "Processing", "r1", 1), ("a", "Stored", "r1", 2), ("a", "Invalid", "r2", 3), ("b", "Stored", "r1", 1)]
    events = spark.createDataFrame(rows, "key string, status string, run_id string, seq int").withColumn("created_at", F.timestamp_seconds("seq"))
    found = {r["key"]: (r["status"], r["attempts"]) for r in ledger_view(events, ["seq"]).collect()}
    assert found == {"a": ("Invalid", 2), "b": ("Stored", 1)}


def test_categorize_new_loads_only(spark, store, drop):
    drop("a.csv", csv(100, 400, 1500, 5000))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    assert categorize_loads(store, as_of=AS_OF) == "job-1-1"
    assert categorize_loads(store, as_of=AS_OF) is None
    drop("b.csv", csv(200))
    reingest(store, drop.inbox, ["b.csv"], "two", as_of=AS_OF)
    assert categorize_loads(store, as_of=AS_OF) == "job-2-2"
    found = sorted((r["file_key"], r["line_number"], r["category"], r["categorized_by_job"]) for r in store.categorized().collect())
    assert found == [("a.csv", 2, "LOW", "job-1-1-co2"), ("a.csv", 3, "NORMAL", "job-1-1-co2"), ("a.csv", 4, "HIGH", "job-1-1-co2"),
                     ("a.csv", 5, "CRITICAL", "job-1-1-co2"), ("b.csv", 2, "LOW", "job-2-2-co2")]
    assert sorted((r["job_id"], r["count"], r["avg"]) for r in store.results().collect()) == [("job-1-1-co2", 4, 1750.0), ("job-2-2-co2", 1, 200.0)]
    drop("a.csv", csv(-5))
    reingest(store, drop.inbox, ["a.csv"], "three", as_of=AS_OF)
    assert [r["file_key"] for r in store.categorized().collect()] == ["b.csv"]


def test_failed_job_is_recorded_and_retried(store, drop):
    drop("a.csv", csv(400))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    bad = Definition("sensor-processing", (Step("processing.categorize", parameters={"thresholds.co2": "3;2;1"}),), 4)
    with pytest.raises(StepFailed):
        categorize_loads(store, "job", bad, as_of=AS_OF)
    row = store.jobs().first()
    assert (row["status"], row["pipeline_version"]) == ("Failed", 4) and "Invalid thresholds" in row["error"]
    assert store.categorized().count() == 0
    assert categorize_loads(store, "job", SENSOR_PROCESSING, as_of=AS_OF) == "job"
    assert [r["status"] for r in store.jobs().collect()] == ["Completed"] and store.categorized().count() == 1


def dirty_inbox(drop, prefix="run"):
    """Twenty files, seven of them to be rejected; returns the keys by outcome."""
    good, bad = [], []
    for i in range(13):
        drop(f"{prefix}/good-{i:02}.csv", csv(*range(300, 310), sensor=f"s-{i % 4}"))
        good.append(f"{prefix}/good-{i:02}.csv")
    broken = {"empty.csv": "", "blank.csv": "  \n", "header.csv": "id;type\n1;2\n", "text.txt": "x", "range.csv": csv(*range(9), -1), "type.csv": csv(*range(10), kind="radiation"),
              "broken.json": "{ not json"}
    for name, content in broken.items():
        drop(f"{prefix}/{name}", content)
        bad.append(f"{prefix}/{name}")
    return good, bad


def test_streams_hold_the_end_to_end_checks(spark, drop, tmp_path):
    good, bad = dirty_inbox(drop)
    root, log, log2 = (str(tmp_path / n) for n in ("store", "log", "log2"))
    run = lambda: ingest_stream(spark, drop.inbox, root, log, max_files=6, as_of=AS_OF).awaitTermination()
    follow = lambda: categorize_stream(spark, root, log2, batch_size=25, as_of=AS_OF).awaitTermination()
    run()
    follow()
    store = SensorStore(spark, root)
    assert store.last_load() > 1
    files = {r["key"]: r for r in store.files().collect()}
    assert sorted(files) == sorted(good + bad)
    assert sorted(k for k, r in files.items() if r["status"] == "Stored") == sorted(good)
    assert files["run/empty.csv"]["error"] == "InvalidFile: Empty file"

    def report(prefix, n_files, n_bad):
        current = store.files()
        placed = current.select(F.when(F.col("status") == "Stored", "processed/").otherwise("invalid/").alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("objects"))
        jobs = store.jobs().withColumn("job_id", F.concat(F.lit(f"{prefix}-"), "job_id"))
        return audit(current, store.categorized(), jobs, placed, prefix, n_files, n_bad, 10).collect()

    checks = report("run", 20, 7)
    assert len(checks) == 12 and [c["name"] for c in checks if not c["ok"]] == []
    before = live(store)
    run()
    follow()
    assert live(store) == before

    drop("run/late.csv", csv(*range(300, 310)))
    run()
    follow()
    assert [c["name"] for c in report("run", 21, 7) if not c["ok"]] == []
    assert len(live(store)) == len(before) + 10
    jobs = store.jobs().orderBy("to_load").collect()
    assert sum(r["processed"] for r in jobs) == 140 and jobs[-1]["processed"] == 10


def test_stream_takes_the_newest_definition(spark, drop, tmp_path):
    lenient = Definition("file-ingestion", (Step("ingest.validate", parameters={"maxInvalidRowRatio": "0.9"}), Step("ingest.store")), 2)
    current = {"definition": Definition("file-ingestion", (Step("ingest.validate"), Step("ingest.store")), 1)}
    root, log = str(tmp_path / "store"), str(tmp_path / "log")
    run = lambda: ingest_stream(spark, drop.inbox, root, log, lambda: current["definition"], as_of=AS_OF).awaitTermination()
    drop("a.csv", csv(1, -1))
    run()
    current["definition"] = lenient
    drop("b.csv", csv(1, -1))
    run()
    found = {r["key"]: (r["status"], r["pipeline_version"], r["row_count"], r["invalid_row_count"]) for r in SensorStore(spark, root).files().collect()}
    assert found == {"a.csv": ("Invalid", 1, 0, 0), "b.csv": ("Stored", 2, 2, 1)}


def test_empty_files_are_rejected_with_their_micro_batch(spark, drop, tmp_path):
    root, log = str(tmp_path / "store"), str(tmp_path / "log")
    store, key_of = SensorStore(spark, root), lambda key: F.regexp_replace(key, "^v[0-9]/", "")
    drop("v1/a.csv", csv(1))
    query = ingest_stream(spark, drop.inbox, root, log, interval_seconds=1, as_of=AS_OF, key_of=key_of)
    try:
        query.processAllAvailable()
        drop("v2/a.csv", "")
        drop("v2/late +1.csv", "")
        query.processAllAvailable()
    finally:
        query.stop()
    found = {r["key"]: (r["status"], r["error"]) for r in store.files().collect()}
    assert found == {"a.csv": ("Invalid", "InvalidFile: Empty file"), "late +1.csv": ("Invalid", "InvalidFile: Empty file")}
    assert live(store) == []


def test_archived_inbox_is_left_empty(spark, drop, tmp_path):
    drop("a.csv", csv(1))
    root, log, archive = (str(tmp_path / n) for n in ("store", "log", "archive"))
    run = lambda: ingest_stream(spark, drop.inbox, root, log, as_of=AS_OF, archive=archive).awaitTermination()
    run()
    drop("b.csv", csv(2))
    run()
    drop("c.csv", csv(3))
    run()
    assert live(SensorStore(spark, root)) == [("a.csv", 2, 1.0), ("b.csv", 2, 2.0), ("c.csv", 2, 3.0)]
    assert not (tmp_path / "inbox" / "a.csv").exists() and list((tmp_path / "archive").rglob("a.csv"))


def test_names_are_taken_literally(spark, store, drop, tmp_path):
    names = ["a[1].csv", "b{x,y}.csv", "c*.csv", "d ?+%20.csv", "cc.csv"]
    for i, name in enumerate(names):
        drop(f"odd/{name}", csv(i))
    ingest_stream(spark, drop.inbox, store.root, str(tmp_path / "log"), max_files=1, as_of=AS_OF).awaitTermination()
    assert live(store) == sorted((f"odd/{name}", 2, float(i)) for i, name in enumerate(names))


def test_oversized_files_are_not_opened(spark, store, drop, tmp_path):
    drop("big.csv", csv(*range(400)))
    drop("small.csv", csv(1))
    limited = Definition("file-ingestion", (Step("ingest.fetch", parameters={"maxBytes": "500"}), Step("ingest.validate"), Step("ingest.store")))
    # Spark fails when it has to load a file over this length.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        ingest_stream(spark, drop.inbox, store.root, str(tmp_path / "log"), limited, as_of=AS_OF).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    found = {r["key"]: (r["status"], r["error"], r["checksum"] is None) for r in store.files().collect()}
    size = len(csv(*range(400)))
    assert found == {"small.csv": ("Stored", None, False), "big.csv": ("Invalid", f"FileTooLarge: File is {size} bytes, max 500", True)}


def test_backlog_is_categorized_in_bounded_jobs(spark, store, drop, tmp_path):
    for i in range(3):
        drop(f"f{i}.csv", csv(400))
        reingest(store, drop.inbox, [f"f{i}.csv"], f"load-{i}", as_of=AS_OF)
    categorize_stream(spark, store.root, str(tmp_path / "log"), as_of=AS_OF, max_loads=2).awaitTermination()
    assert sorted((r["job_id"], r["processed"]) for r in store.jobs().collect()) == [("job-1-2-co2", 2), ("job-3-3-co2", 1)]
    assert store.categorized().count() == 3


def test_interval_range():
    assert check_interval(15) == 15
    for seconds in (0, 3601):
        with pytest.raises(ValueError):
            check_interval(seconds)


def test_error_report_text_is_cut(spark):
    verdicts = spark.createDataFrame([("k", "Invalid", "ingest.validate", "InvalidRows", "x" * 5000, ["ingest.fetch"])],
                                     "file_key string, status string, failed_step string, error_type string, error string, completed_steps array<string>")
    report = error_reports(verdicts, instant("2030-01-01"), "p", 3).first()["report"]
    assert '"pipeline":"p:v3"' in report and len(report) > 5000


def test_a_base_used_again_keeps_its_earlier_rows(spark, store, drop):
    for i in range(2):
        drop(f"f{i}.csv", csv(400 + i))
        reingest(store, drop.inbox, [f"f{i}.csv"], f"load-{i}", as_of=AS_OF)
        categorize_loads(store, "nightly", as_of=AS_OF)
    assert sorted(r["file_key"] for r in store.categorized().collect()) == ["f0.csv", "f1.csv"]
    assert store.results().agg({"count": "sum"}).first()[0] == 2
    assert sorted(r["span"] for r in store.jobs().collect()) == ["1-1", "2-2"]


def test_a_job_cut_before_its_end_leaves_no_rows(spark, store, drop, monkeypatch):
    drop("a.csv", csv(400))
    reingest(store, drop.inbox, ["a.csv"], "load-1", as_of=AS_OF)
    write = SensorStore.write_job

    def cut(self, table, *rest, **named):
        if table == "jobs":
            raise KeyboardInterrupt
        write(self, table, *rest, **named)

    monkeypatch.setattr(SensorStore, "write_job", cut)
    with pytest.raises(KeyboardInterrupt):
        categorize_loads(store, as_of=AS_OF)
    monkeypatch.setattr(SensorStore, "write_job", write)
    assert store.results().count() == 0 and store.categorized().count() == 0
    drop("b.csv", csv(500))
    reingest(store, drop.inbox, ["b.csv"], "load-2", as_of=AS_OF)
    categorize_loads(store, as_of=AS_OF)
    assert store.results().agg({"count": "sum"}).first()[0] == 2 and store.categorized().count() == 2


def test_an_error_while_writing_leaves_failed_rows(spark, store, drop, monkeypatch):
    drop("a.csv", csv(400))
    reingest(store, drop.inbox, ["a.csv"], "load-1", as_of=AS_OF)
    write = SensorStore.write_job

    def broken(self, table, *rest, **named):
        if table == "results":
            raise OSError("disk full")
        write(self, table, *rest, **named)

    monkeypatch.setattr(SensorStore, "write_job", broken)
    with pytest.raises(OSError):
        categorize_loads(store, as_of=AS_OF)
    monkeypatch.setattr(SensorStore, "write_job", write)
    assert [(r["status"], r["error"]) for r in store.jobs().collect()] == [("Failed", "disk full")]
    categorize_loads(store, "again", as_of=AS_OF)
    assert store.categorized().count() == 1


def test_a_source_may_hold_any_characters(spark, store, drop):
    drop("a.csv", csv(1))
    reingest(store, drop.inbox, ["a.csv"], "s3://x/a:b c%2F*", as_of=AS_OF)
    assert store.committed("s3://x/a:b c%2F*") and not store.committed("s3://x/a:b c/*")
    assert store.events().first()["source"] == "s3://x/a:b c%2F*" and store.files().count() == 1


def states(store):
    return {r["key"]: (r["status"], r["attempts"]) for r in store.files().collect()}


def test_a_writer_that_was_given_up_is_not_seen(spark, store, drop):
    drop("a.csv", csv(1))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    drop("a.csv", csv(2))
    files = folder_files(spark, drop.inbox)
    late = store.claim("two", files.select(F.col("file_key").alias("key"), "path"), instant("2030-01-01"))
    assert states(store) == {"a.csv": ("Processing", 2)} and live(store) == [("a.csv", 2, 1.0)] and not store.committed("two")
    plan = plan_load(files.drop("path"), instant("2030-01-01"))
    store.write_load(late.load, with_ids(plan.readings.withColumn("value", F.lit(-9.0)), plan.verdicts, store.next_id())[0])
    other = SensorStore(spark, store.root)
    assert ingest_load(other, files, "two", as_of=AS_OF) == late.load + 1
    with pytest.raises(LateWriter):
        store.commit_load(late, store.events().drop("load", "source").where("key = 'a.csv'"))
    # It may also pass its own check and write after the next attempt was claimed: the readers' fence holds.
    store.events().where("key = 'a.csv' and source = 'one'").drop("load", "source").write.parquet(f"{store.path('ledger')}/source=two/load={late.load}")
    assert live(store) == [("a.csv", 2, 2.0)] and states(store) == {"a.csv": ("Stored", 3)}
    assert store.committed("two") and ingest_load(store, files, "two", as_of=AS_OF) is None


def test_files_that_vanished_are_an_outcome(spark, store, drop, tmp_path):
    drop("a.csv", csv(1))
    drop("b.csv", csv(2))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    (tmp_path / "inbox" / "b.csv").unlink()
    assert reingest(store, drop.inbox, ["a.csv", "b.csv", "never.csv"], "two", as_of=AS_OF) == 2
    # A file that was stored before keeps its rows and its row; one that never was is Missing.
    assert states(store) == {"a.csv": ("Stored", 2), "b.csv": ("Stored", 2), "never.csv": ("Missing", 1)}
    assert live(store) == [("a.csv", 2, 1.0), ("b.csv", 2, 2.0)]
    assert reingest(store, drop.inbox, ["gone.csv"], "three", as_of=AS_OF) == 3 and states(store)["gone.csv"] == ("Missing", 1)


def test_a_stream_goes_on_when_a_file_vanishes(spark, store, drop, tmp_path):
    drop("a.csv", csv(1))
    drop("b.csv", csv(2))

    def taken_away():
        # Asked after the micro-batch has named its files.
        (tmp_path / "inbox" / "b.csv").unlink(missing_ok=True)
        return Definition("file-ingestion", (Step("ingest.validate"), Step("ingest.store")))

    ingest_stream(spark, drop.inbox, store.root, str(tmp_path / "log"), taken_away, as_of=AS_OF).awaitTermination()
    assert states(store) == {"a.csv": ("Stored", 1), "b.csv": ("Missing", 1)}
    assert [(r["listed"], r["dispatched"], r["missing"]) for r in store.scans().collect()] == [(2, 1, 1)]


def test_a_sweep_takes_up_dead_loads_once(spark, store, drop, tmp_path):
    drop("a.csv", csv(1))
    files = folder_files(spark, drop.inbox)
    keys = files.select(F.col("file_key").alias("key"), "path")
    store.claim("dead", keys, instant("2029-12-31 23:00:00"))
    assert store.abandoned(instant("2029-12-31 22:59:00")).count() == 0
    assert sweep(store, drop.inbox, instant("2029-12-31 22:59:00"), as_of=AS_OF) == 0
    assert sweep(store, drop.inbox, instant("2029-12-31 23:30:00"), as_of=AS_OF) == 1
    assert sweep(store, drop.inbox, instant("2029-12-31 23:30:00"), as_of=AS_OF) == 0
    assert states(store) == {"a.csv": ("Stored", 2)} and live(store) == [("a.csv", 2, 1.0)]


def test_the_sweep_clock_goes_on_over_restarts(spark, store):
    assert sweep_due(store, AS_OF, 60)
    store.write_scan("inbox-0", F.lit(AS_OF), {"re_dispatched": 2}, True)
    store.write_scan("inbox-1", F.lit(AS_OF + timedelta(seconds=50)), {}, False)
    again = SensorStore(spark, store.root)
    assert not sweep_due(again, AS_OF + timedelta(seconds=59), 60) and sweep_due(again, AS_OF + timedelta(seconds=60), 60)


def test_a_quiet_inbox_is_swept_by_the_clock(spark, store, drop, tmp_path):
    drop("a.csv", csv(1))
    keys = folder_files(spark, drop.inbox).select(F.col("file_key").alias("key"), "path")
    store.claim("dead", keys, instant("2029-12-31 23:00:00"))
    query = sweep_stream(spark, drop.inbox, store.root, str(tmp_path / "clock"), 1, 15, as_of=AS_OF)
    try:
        deadline = time.time() + 60
        while time.time() < deadline and store.scans().where("re_dispatched = 1").isEmpty():
            time.sleep(1)
    finally:
        query.stop()
    assert states(store) == {"a.csv": ("Stored", 2)}


def test_a_job_goes_on_behind_its_last_step(spark, store, drop, monkeypatch):
    for i in range(3):
        drop(f"f{i}.csv", csv(*range(400, 403 + i)))
        reingest(store, drop.inbox, [f"f{i}.csv"], f"load-{i}", as_of=AS_OF)
    progress = lambda: sorted((r["step"], r["processed"], r["batches"]) for r in store.progress().where("sensor_type = 'co2'").collect())
    assert categorize_loads(store, "job", batch_size=2, as_of=AS_OF, loads_per_step=1, max_steps=2) == "job"
    assert progress() == [(0, 0, 0), (1, 3, 2), (2, 7, 4)] and store.jobs().count() == 0 and store.results().count() == 0
    assert {(r["status"], r["processed"]) for r in store.job_states().where("sensor_type = 'co2'").collect()} == {("Running", 7)}
    read = []
    measurements = SensorStore.measurements
    monkeypatch.setattr(SensorStore, "measurements", lambda self, after=0, upto=None: read.append((after, upto)) or measurements(self, after, upto))
    categorize_loads(store, "job", batch_size=2, as_of=AS_OF, loads_per_step=1)
    assert read == [(2, 3)]
    assert [(r["job_id"], r["status"], r["processed"], r["batches"]) for r in store.job_states().collect()] == [("job-co2", "Completed", 12, 7)]
    found = {r["batch_number"]: r["count"] for r in store.results().collect()}
    assert found == {1: 2, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1} and store.categorized().count() == 12


def test_a_batch_fails_alone_and_is_taken_up_later(spark, store, drop):
    drop("a.csv", csv(400, 401, 402) + csv(20, 21, kind="humidity", unit="%").removeprefix(HEADER))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    steps = SENSOR_PROCESSING.steps[1:]
    broken = Step("processing.categorize", continue_on_error=True, parameters={"thresholds.humidity": "3;2;1"})
    categorize_loads(store, "job", Definition("sensor-processing", (broken, *steps)), 2, AS_OF)
    jobs = {r["sensor_type"]: (r["status"], r["processed"], r["batches"], r["failed_batches"]) for r in store.jobs().collect()}
    assert jobs == {"co2": ("Completed", 3, 2, 0), "humidity": ("Completed", 2, 1, 1)}
    failure = store.failures().first()
    assert (failure["job_id"], failure["batch_number"], failure["failed_step"], failure["rows"]) == ("job-humidity", 1, "processing.categorize", 2)
    assert failure["error"].startswith("Invalid thresholds '3;2;1'")
    assert {r["sensor_type"] for r in store.categorized().collect()} == {"co2"} == {r["sensor_type"] for r in store.results().collect()}
    assert categorize_missed(store, "again", as_of=AS_OF) == "again"
    assert store.uncategorized().count() == 0 and store.categorized().count() == 5
    # A step that may not be skipped names the first batch it failed on.
    drop("b.csv", csv(20, kind="humidity", unit="%"))
    reingest(store, drop.inbox, ["b.csv"], "two", as_of=AS_OF)
    with pytest.raises(StepFailed, match="Step processing.categorize failed on batch 1: Invalid thresholds"):
        categorize_loads(store, "strict", Definition("sensor-processing", (Step("processing.categorize", parameters=broken.parameters), *steps)), 2, AS_OF)


def test_compaction_keeps_what_a_store_says(spark, store, drop):
    drop("a.csv", csv(400, 401))
    drop("b.csv", csv(-1))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    store.claim("two", folder_files(spark, drop.inbox).select(F.col("file_key").alias("key"), "path"), instant("2030-01-01"))
    drop("a.csv", csv(500))
    reingest(store, drop.inbox, ["a.csv"], "two", as_of=AS_OF)
    categorize_loads(store, "job", as_of=AS_OF)
    store.write_scan("inbox-0", F.lit(AS_OF), {"listed": 2}, True)
    compact = SensorStore(spark, store.compact(store.root + "-compact").root)
    for table in ("files", "measurements", "categorized", "results", "jobs", "failures", "reports", "scans"):
        was, now = (getattr(s, table)() for s in (store, compact))
        columns = sorted(set(was.columns) - {"token"})
        rows = lambda frame: sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
        assert rows(was) == rows(now), table
    assert compact.committed("one") and compact.committed("two") and not compact.committed("three")
    assert (compact.next_load(), compact.next_id()) == (store.next_load(), store.next_id()) and compact.last_categorized_load() == 3
    drop("b.csv", csv(7))
    assert reingest(compact, drop.inbox, ["b.csv"], "three", as_of=AS_OF) == 4 and states(compact)["b.csv"] == ("Stored", 3)
    twice = SensorStore(spark, compact.compact(store.root + "-twice").root)
    assert states(twice) == states(compact) and twice.committed("one") and twice.next_load() == 5 and live(twice) == live(compact)


def test_converted_files_feed_the_store(spark, store, drop):
    drop("a.csv", csv("68", kind="temperature", unit="F"))
    drop("b.csv", csv(-1))
    load = ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    back = read_normalized(spark, store.converted_path(load))
    assert [(r["file_key"], r["value"], r["unit"]) for r in back.collect()] == [("a.csv", 20.0, "C")] and live(store) == [("a.csv", 2, 20.0)]
    plain = Definition("file-ingestion", (Step("ingest.validate"), Step("ingest.convert", enabled=False), Step("ingest.store")))
    load = reingest(store, drop.inbox, ["a.csv"], "two", plain, AS_OF)
    assert live(store) == [("a.csv", 2, 20.0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_normalized(spark, store.converted_path(load))


def test_compaction_deals_a_folder_over_tasks(spark, store, drop, monkeypatch):
    """A job's results lie in one folder; more than one task writes them."""
    from fieldgauge.operators import store as module

    monkeypatch.setattr(module, "PART_IDS", 8)
    monkeypatch.setattr(module, "PART_BATCHES", 1)
    drop("a.csv", csv(*range(400, 464)))
    ingest_folder(store, drop.inbox, "one", as_of=AS_OF)
    categorize_loads(store, "job", batch_size=2, as_of=AS_OF)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compact = store.compact(store.root + "-compact")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table in ("measurements", "categorized", "results"):
        was, now = (getattr(s, table)() for s in (store, compact))
        assert sorted(map(repr, was.collect())) == sorted(map(repr, now.select(was.columns).collect()))
        assert len(now.inputFiles()) > 1, table


def test_asked_files_are_listed_once(spark, monkeypatch):
    """The folder is gone over once for all names that are asked for."""
    from fieldgauge.plans import queries_loads

    class Asked(Exception):
        pass

    def asked(spark, root, paths, key_of):
        raise Asked(len(paths), len(seen))

    seen, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(queries_loads, "ingest_folder", lambda *args, **kwargs: None)
    monkeypatch.setattr(queries_loads, "named_files", asked)
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(1) or collect(self))
    with pytest.raises(Asked) as found:
        queries_loads.reingested_store(spark, "/root/testdata/sf0.001")
    paths, collects = found.value.args
    # One for the sizes, one for the names.
    assert paths >= 10 and collects == 2
