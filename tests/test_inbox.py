"""Inboxes of very many small files."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldgauge.operators.store import SensorStore, folder_value
from fieldgauge.plans import ingest, standins
from fieldgauge.plans.ingest import folder_files, ingest_loads, named_files
from fieldgauge.plans.queries_streams import AS_OF, drop_folder, folder_key
from fieldgauge.session import LISTING_TASKS, configure
from fieldgauge.sources.listing import list_objects
from fieldgauge.streaming.categorizer import categorize_stream
from fieldgauge.streaming.inbox import ingest_stream, sweep_due

SF = "/root/testdata/sf0.01"


def test_files_are_put_under_their_names(spark):
    inbox = drop_folder(spark, SF)
    found = folder_files(spark, inbox, folder_key).select("file_key", "size_bytes", F.md5("content").alias("sum"), "path").collect()
    made = standins.sensor_files(spark, SF).select("file_key", F.md5(F.concat("content", F.lit("\n").cast("binary"))).alias("sum")).collect()
    assert sorted((r["file_key"], r["sum"]) for r in found) == sorted(map(tuple, made))
    # A folder per file made listings and folders as many as files.
    assert len({r["path"].rsplit("/", 1)[0] for r in found}) == 1


def test_small_files_share_tasks(spark, drop):
    for n in range(600):
        drop(f"{n}.csv", "x")
    cores = spark.sparkContext.defaultParallelism
    assert folder_files(spark, drop.inbox).rdd.getNumPartitions() <= cores
    assert list_objects(spark, drop.inbox).rdd.getNumPartitions() <= cores
    paths = [f"{drop.inbox}/{n}.csv" for n in range(600)]
    assert named_files(spark, drop.inbox, paths)[0].rdd.getNumPartitions() <= cores


def test_large_and_empty_files_are_still_found(spark, drop):
    drop("a.csv", "x" * 10), drop("b.csv", "x" * 30), drop("c.csv", "")
    read = lambda files: sorted((r["file_key"], r["size_bytes"], r["content"] and bytes(r["content"])) for r in files.collect())
    expected = [("a.csv", 10, b"x" * 10), ("b.csv", 30, None), ("c.csv", 0, b"")]
    assert read(folder_files(spark, drop.inbox, None, 20)) == expected
    paths = [f"{drop.inbox}/{name}.csv" for name in "abc"]
    assert read(named_files(spark, drop.inbox, paths, None, 20)[0]) == expected


def test_scan_log_is_not_read_by_every_scan(spark, tmp_path, monkeypatch):
    store, asked = SensorStore(spark, str(tmp_path / "store")), []
    scans = SensorStore.scans
    monkeypatch.setattr(SensorStore, "scans", lambda self: asked.append(1) or scans(self))
    for n in range(3):
        sweep_due(store, AS_OF, 60)
        store.write_scan(f"inbox-{n}", F.lit(AS_OF), {"listed": 1}, False)
    assert len(asked) == 1
    store.write_scan("inbox-3", F.lit(AS_OF), {}, True)
    assert not sweep_due(store, AS_OF, 60) and len(asked) == 2


def test_stream_sets_the_listing_for_itself_only(spark, drop, tmp_path):
    """Loads of the stream are listed by a task per core, and its rows are all there."""
    for n in range(40):
        drop(f"{n}.csv", "sensor_id,sensor_type,timestamp,value,unit\ns-1,temperature,2026-01-01T00:00:00Z,20,C\n")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    store = str(tmp_path / "store")
    ingest_stream(spark, drop.inbox, store, str(tmp_path / "log"), max_files=35, as_of=AS_OF).awaitTermination()
    assert spark.conf.get(name) == before
    assert SensorStore(spark, store).measurements().count() == 40


HEADER = "sensor_id,sensor_type,timestamp,value,unit"


def readings(*values):
    return "\n".join([HEADER, *(f"s-{v},temperature,2026-01-01T00:00:00Z,{v},C" for v in values), ""])


def live(store):
    return sorted((r["file_key"], r["line_number"], r["value"]) for r in store.measurements().collect())


def scans(store):
    return sorted((r["source"], r["listed"], r["dispatched"], r["missing"]) for r in store.scans().collect())


def test_loads_of_a_backlog_share_a_pass(spark, drop, tmp_path):
    """Loads stay as small as asked for and each leaves its scan, but they are read, checked and written together."""
    for n in range(11):
        drop(f"{n:02}.csv", readings(n, n + 20))
        os.utime(Path(drop.inbox) / f"{n:02}.csv", (1_700_000_000 + n,) * 2)
    drop("11.csv", ""), drop("12.csv", readings("x")), drop("13.json", "[")
    store, log = SensorStore(spark, str(tmp_path / "store")), tmp_path / "log"
    ingest_stream(spark, drop.inbox, store.root, str(log), max_files=5, as_of=AS_OF).awaitTermination()
    assert [p.name for p in (log / "commits").glob("[0-9]*")] == ["0"]
    assert scans(store) == [("inbox-0", 5, 5, 0), ("inbox-0.1", 5, 5, 0), ("inbox-0.2", 4, 4, 0)]
    assert live(store) == sorted((f"{n:02}.csv", line, float(v)) for n in range(11) for line, v in ((2, n), (3, n + 20)))
    files = {r["key"]: (r["status"], r["load"], r["source"], r["run_id"], r["attempts"]) for r in store.files().collect()}
    assert files["04.csv"] == ("Stored", 1, "inbox-0", "inbox-0", 1) and files["05.csv"] == ("Stored", 2, "inbox-0.1", "inbox-0.1", 1)
    assert files["10.csv"][:2] == ("Stored", 3) and {files[k][:2] for k in ("11.csv", "12.csv", "13.json")} == {("Invalid", 3)}
    assert store.reports().groupBy("load").count().collect() == [(3, 3)]
    # A stored file takes as many ids as it has lines, load after load.
    ids = {(r["file_key"], r["line_number"]): r["id"] for r in store.measurements().collect()}
    assert ids == {(f"{n:02}.csv", line): 3 * n + line for n in range(11) for line in (2, 3)}
    assert store.claims().where("key is not null").groupBy("load").count().orderBy("load").collect() == [(1, 5), (2, 5), (3, 4)]
    assert SensorStore(spark, store.root).next_load() == 4 and SensorStore(spark, store.root).next_id() == store.events().agg(F.max("last_id")).first()[0] + 1


def test_a_later_load_of_a_pass_replaces_an_earlier_one(spark, drop, tmp_path):
    drop("z/a.csv", readings(1, 2)), drop("b.csv", readings(3)), drop("a/a.csv", readings(4))
    for age, name in enumerate(("z/a.csv", "b.csv", "a/a.csv")):
        os.utime(Path(drop.inbox) / name, (1_700_000_000 + age,) * 2)
    store = SensorStore(spark, str(tmp_path / "store"))
    ingest_stream(spark, drop.inbox, store.root, str(tmp_path / "log"), max_files=1, as_of=AS_OF, key_of=folder_key).awaitTermination()
    assert live(store) == [("a.csv", 2, 4.0), ("b.csv", 2, 3.0)]


def test_a_repeated_pass_takes_only_loads_not_committed(spark, drop, tmp_path):
    for n in range(6):
        drop(f"{n}.csv", readings(n))
        os.utime(Path(drop.inbox) / f"{n}.csv", (1_700_000_000 + n,) * 2)
    root, log = tmp_path / "store", tmp_path / "log"
    run = lambda most=2: ingest_stream(spark, drop.inbox, str(root), str(log), max_files=most, as_of=AS_OF).awaitTermination()
    attempts = lambda: {r["key"]: r["attempts"] for r in SensorStore(spark, str(root)).files().collect()}

    def cut():
        for p in (log / "commits").iterdir():
            p.unlink()

    run()
    cut()
    run()
    assert attempts() == {f"{n}.csv": 1 for n in range(6)}
    for p in (root / "ledger" / "source=inbox-0.1").rglob("*"):
        if p.is_file():
            p.unlink()
    (Path(drop.inbox) / "3.csv").unlink()
    cut()
    run()
    assert attempts() == {f"{n}.csv": 2 if n in (2, 3) else 1 for n in range(6)}
    store = SensorStore(spark, str(root))
    assert live(store) == [(f"{n}.csv", 2, float(n)) for n in (0, 1, 2, 4, 5)]
    assert {r["key"]: r["status"] for r in store.files().collect()}["3.csv"] == "Missing"
    assert scans(store) == [("inbox-0", 2, 2, 0), ("inbox-0.1", 2, 1, 1), ("inbox-0.2", 2, 2, 0)]


def test_a_load_of_all_files_is_not_taken_again_in_parts(spark, drop, tmp_path):
    for n in range(4):
        drop(f"{n}.csv", readings(n))
    root, log = str(tmp_path / "store"), tmp_path / "log"
    for most in (10, 1):
        ingest_stream(spark, drop.inbox, root, str(log), max_files=most, as_of=AS_OF).awaitTermination()
        for p in (log / "commits").iterdir():
            p.unlink()
    assert {r["attempts"] for r in SensorStore(spark, root).files().collect()} == {1}


def test_an_interval_takes_one_load_a_scan(spark, drop, tmp_path):
    for n in range(3):
        drop(f"{n}.csv", readings(n))
    store = SensorStore(spark, str(tmp_path / "store"))
    query = ingest_stream(spark, drop.inbox, store.root, str(tmp_path / "log"), interval_seconds=1, max_files=2, as_of=AS_OF)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert scans(store) == [("inbox-0", 2, 2, 0), ("inbox-1", 1, 1, 0)]


def test_names_are_listed_by_few_tasks(spark):
    """A stream lists the names of its micro-batches with the settings of the session; Spark would make a task of each."""
    asked = spark.conf.get(LISTING_TASKS)
    try:
        spark.conf.unset(LISTING_TASKS)
        configure(spark)
        assert int(spark.conf.get(LISTING_TASKS)) <= max(32, spark.sparkContext.defaultParallelism)
        spark.conf.set(LISTING_TASKS, "77")
        configure(spark)
        assert spark.conf.get(LISTING_TASKS) == "77"
    finally:
        spark.conf.set(LISTING_TASKS, asked)


def test_paths_are_asked_for_one_by_one_only_where_some_are_gone(spark, drop, monkeypatch):
    drop("a.csv", readings(1)), drop("b.csv", readings(2))
    asked, existing = [], ingest.existing_paths
    monkeypatch.setattr(ingest, "existing_paths", lambda spark, paths: asked.append(len(paths)) or existing(spark, paths))
    paths = [f"{drop.inbox}/{name}.csv" for name in "ab"]
    assert named_files(spark, drop.inbox, paths)[0].count() == 2 and asked == []
    files, missing, gone = named_files(spark, drop.inbox, [*paths, f"{drop.inbox}/c.csv"])
    assert (files.count(), [r["key"] for r in missing.collect()], gone, asked) == (2, ["c.csv"], 1, [3])


def test_loads_of_a_pass_become_visible_in_order(spark, drop, tmp_path):
    """The categorizer takes all loads up to the newest, so none may be seen before one ahead of it."""
    for n in range(3):
        drop(f"{n}.csv", readings(n))
    store, sources = SensorStore(spark, str(tmp_path / "store")), ["c", "b:1", "a"]
    part = F.substring("file_key", 1, 1).cast("int").alias("part")
    take = lambda some: ingest_loads(store, folder_files(spark, drop.inbox).select("*", part), some, as_of=AS_OF)
    blocked = tmp_path / "store" / "ledger" / f"source={folder_value('b:1')}"
    blocked.parent.mkdir(parents=True)
    blocked.write_text("")
    with pytest.raises(Exception):
        take(sources)
    assert [p.name for p in blocked.parent.glob("source=*/load=*")] == ["load=1"]
    blocked.unlink()
    assert take(sources) == [4, 5, 6]
    categorize_stream(spark, store.root, str(tmp_path / "categories"), as_of=AS_OF).awaitTermination()
    assert sorted((r["file_key"], r["category"], r["load"]) for r in store.categorized().collect()) == [("0.csv", "LOW", 4), ("1.csv", "LOW", 5), ("2.csv", "LOW", 6)]
