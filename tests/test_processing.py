import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldgauge.functions.thresholds import parse_thresholds, threshold_struct
from fieldgauge.functions.times import instant
from fieldgauge.operators.batches import assign_batches, batch_number, batch_ranges, fetch_page, with_row_number
from fieldgauge.operators.results import apply_categories, categorize, check_types, job_progress, job_totals, per_sensor_results
from fieldgauge.plans.process import plan_job
from fieldgauge.plans.steps import SENSOR_PROCESSING, Definition, Step, StepFailed, decode_definitions, definition_errors, encode_definitions, from_json
from fieldgauge.plans.steps import load_definition, reset_definition, run_steps, save_definition, to_json


def measurements(spark, rows):
    return spark.createDataFrame(rows, "id bigint, sensor_type string, sensor_id string, value double")


def skewed(seed=7, n=3000):
    """Ids over the whole positive range; one type holds most of them."""
    chance = random.Random(seed)
    ids = {chance.choice([chance.randrange(500), chance.randrange(1 << 30), chance.randrange(1 << 62)]) for _ in range(n)}
    return [(i, chance.choice(["hot"] * 8 + ["cold", "rare"]), f"s{i % 9}", chance.uniform(-5, 60)) for i in ids]


def plain_numbers(frame):
    order = Window.partitionBy("sensor_type").orderBy("id")
    return {r["id"]: r["n"] for r in frame.withColumn("n", F.row_number().over(order)).collect()}


@pytest.mark.parametrize("bits", [(20, 42), (3, 8), (8, 30)])
def test_sliced_row_numbers_equal_the_plain_window(spark, bits):
    frame = measurements(spark, skewed())
    numbered = with_row_number(frame, slice_bits=bits[0], block_bits=bits[1])
    assert numbered.columns == [*frame.columns, "row_number"]
    assert {r["id"]: r["row_number"] for r in numbered.collect()} == plain_numbers(frame)


def test_sliced_row_numbers_with_negative_ids(spark):
    frame = measurements(spark, [(i * 37 - 5000, "t", "s", 1.0) for i in range(300)])
    assert {r["id"]: r["row_number"] for r in with_row_number(frame, slice_bits=4, block_bits=9).collect()} == plain_numbers(frame)


def test_eleven_batches(spark):
    frame = measurements(spark, [(i, "temperature", "s", 1.0) for i in range(1050)])
    ranges = batch_ranges(assign_batches(frame, 100)).orderBy("batch_number").collect()
    assert len(ranges) == 11 and sum(r["count"] for r in ranges) == 1050 and ranges[-1]["count"] == 50
    assert (ranges[1]["first_id"], ranges[1]["last_id"]) == (100, 199)


def test_schedule_matches_a_sequential_cursor(spark):
    sizes, wanted, row = [(1, 7), (3, 2), (4, 11)], [], 0
    for batch in range(1, 12):
        size = [s for first, s in sizes if first <= batch][-1]
        wanted += [batch] * size
    numbers = spark.range(1, len(wanted) + 1).select(batch_number(F.col("id"), sizes).alias("b")).collect()
    assert [r["b"] for r in numbers] == wanted


@pytest.mark.parametrize("size", [0, 10_001, -1])
def test_batch_size_range(spark, size):
    with pytest.raises(ValueError, match="Batch size"):
        batch_number(F.col("id"), [(1, size)])


def test_cursor_limit_and_page(spark):
    frame = measurements(spark, skewed())
    batched = assign_batches(frame, 50, max_batches=3, after_id=100, sensor_types=["hot"])
    wanted = sorted(i for i, kind, *_ in skewed() if kind == "hot" and i > 100)
    assert sorted(r["id"] for r in batched.collect()) == wanted[:150]
    assert [r["id"] for r in fetch_page(frame, "hot", 100, 40).collect()] == wanted[:40]


def test_only_uncategorized_sees_its_own_rows(spark):
    rows = [(1, "t", "s", 1.0, None, None), (2, "t", "s", 1.0, "LOW", "other"), (3, "t", "s", 1.0, "LOW", "mine"), (4, "t", "s", 1.0, "LOW", None)]
    frame = spark.createDataFrame(rows, "id bigint, sensor_type string, sensor_id string, value double, category string, categorized_by_job string")
    ids = lambda **options: sorted(r["id"] for r in assign_batches(frame, 10, **options).collect())
    assert ids(job=F.lit("mine")) == [1, 3]
    assert ids() == [1]
    assert ids(only_uncategorized=False) == [1, 2, 3, 4]


@pytest.mark.parametrize("value, name", [(-5, "LOW"), (4.9999, "LOW"), (5, "NORMAL"), (20, "NORMAL"), (30, "HIGH"), (45, "CRITICAL"), (50, "CRITICAL")])
def test_category_edges(spark, value, name):
    frame = measurements(spark, [(1, "Temperature", "s", float(value))])
    assert categorize(frame).first()["category"] == name
    assert categorize(frame, {"thresholds.Temperature": "5, 30 ;45"}).first()["category"] == name


def test_threshold_lookup(spark):
    frame = measurements(spark, [(1, "co2", "s", 1.0), (2, "CO2", "s", 1.0), (3, "other", "s", 1e300)])
    rows = categorize(frame, {"thresholds.co2": "0;1;2"}).orderBy("id").collect()
    assert [r["category"] for r in rows] == ["HIGH", "LOW", "NORMAL"]


@pytest.mark.parametrize("text", ["30;5;45", "1;2", "1;2;3;4", "a;b;c", ""])
def test_bad_thresholds(spark, text):
    with pytest.raises(ValueError, match="Invalid thresholds"):
        parse_thresholds(text)
    with pytest.raises(Exception, match="Invalid thresholds"):
        spark.range(1).select(threshold_struct(F.lit(text))).collect()


def test_threshold_column(spark):
    row = spark.range(1).select(threshold_struct(F.lit("1, 2; 3")).alias("t")).first()["t"]
    assert (row["low"], row["high"], row["critical"]) == parse_thresholds("1, 2; 3") == (1.0, 2.0, 3.0)


def test_update_touches_staged_rows_only(spark):
    rows = [(1, 5.0, None, None, None), (2, 5.0, "LOW", None, "old")]
    frame = spark.createDataFrame(rows, "id bigint, value double, category string, categorized_at timestamp, categorized_by_job string")
    staged = spark.createDataFrame([(1, "HIGH"), (9, "HIGH")], "id bigint, category string")
    updated = {r["id"]: r for r in apply_categories(frame, staged, F.lit("new"), instant("2030-01-01")).collect()}
    assert (updated[1]["category"], updated[1]["categorized_by_job"]) == ("HIGH", "new") and updated[1]["categorized_at"] is not None
    assert (updated[2]["category"], updated[2]["categorized_by_job"], updated[2]["categorized_at"]) == ("LOW", "old", None)


def test_results_by_brute_force(spark):
    data = [(i, "temperature", s, round(v, 4)) for i, _, s, v in skewed(3)]
    out = per_sensor_results(categorize(measurements(spark, data)), ("sensor_id",)).collect()
    for row in out:
        mine = [v for _, _, s, v in data if s == row["sensor_id"]]
        assert (row["count"], row["min"], row["max"]) == (len(mine), min(mine), max(mine))
        assert row["avg"] == pytest.approx(sum(mine) / len(mine), abs=5.1e-5)
        assert row["low_count"] == sum(v < 5 for v in mine) and row["critical_count"] == sum(v >= 45 for v in mine)
        assert row["low_count"] + row["normal_count"] + row["high_count"] + row["critical_count"] == row["count"]
    assert len(out) == 9


def test_totals_and_progress(spark):
    ranges = batch_ranges(assign_batches(measurements(spark, skewed()), 100))
    failed = spark.createDataFrame([("hot", 2), ("hot", 2), ("hot", 5)], "sensor_type string, batch_number int")
    totals = {r["sensor_type"]: r for r in job_totals(ranges, "job", failed).collect()}
    hot = [i for i, kind, *_ in skewed() if kind == "hot"]
    assert (totals["hot"]["job_id"], totals["hot"]["processed"], totals["hot"]["failed_batches"], totals["hot"]["cursor"]) == ("job-hot", len(hot), 2, max(hot))
    steps = job_progress(ranges).where("sensor_type = 'hot'").orderBy("batch_number").collect()
    assert [r["processed"] for r in steps] == [min(100 * b, len(hot)) for b in range(1, len(steps) + 1)]


def test_job_types_are_refused_as_a_whole():
    assert check_types(["CO2", "humidity"]) == ["CO2", "humidity"]
    with pytest.raises(ValueError, match="Unknown sensor types: a, b"):
        check_types(["co2", "a", "b"])


# -- step lists ---------------------------------------------------------------------------


def test_step_list_equals_hand_composed(spark):
    frame = measurements(spark, [(i, "temperature" if i % 3 else "co2", f"s{i % 5}", float(i % 60)) for i in range(1200)])
    plan = plan_job(frame, "job", SENSOR_PROCESSING, 100, instant("2030-01-01"))
    params = SENSOR_PROCESSING.step("processing.categorize").parameters
    by_hand = per_sensor_results(categorize(assign_batches(frame, 100), params))
    assert sorted(map(tuple, plan.run.results.collect())) == sorted(map(tuple, by_hand.collect()))
    row = plan.run.rows.first()
    assert row["categorized_by_job"] == f"job-{row['sensor_type']}" and plan.run.updates


def test_failing_step(spark):
    frame = measurements(spark, [(1, "co2", "s", 1.0)])
    bad = Step("processing.categorize", parameters={"thresholds.co2": "3;2;1"})
    with pytest.raises(StepFailed, match="Step processing.categorize failed: ValueError: Invalid thresholds"):
        run_steps(frame, Definition("sensor-processing", (bad,)))
    skipped = Definition("sensor-processing", (Step(bad.activity, continue_on_error=True, parameters=bad.parameters), Step("processing.cleanup")))
    run = run_steps(frame, skipped)
    assert run.failed_steps == ["processing.categorize"] and run.completed == ["processing.cleanup"]


def test_definition_round_trip(spark):
    assert from_json(to_json(SENSOR_PROCESSING)) == SENSOR_PROCESSING
    table = spark.createDataFrame(
        [(SENSOR_PROCESSING.name, v, to_json(SENSOR_PROCESSING)) for v in (1, 2, 10)] + [("other", 11, "{}")], "name string, version int, definition_json string"
    )
    assert load_definition(table, SENSOR_PROCESSING.name).version == 10
    assert load_definition(table, SENSOR_PROCESSING.name, 2).version == 2
    with pytest.raises(LookupError):
        load_definition(table, "missing")
    decoded = decode_definitions(table.where("version = 10")).withColumn("comment", F.lit("x"))
    again = encode_definitions(decoded).first()
    assert from_json(again["definition_json"]).steps == SENSOR_PROCESSING.steps


def test_saving_and_resetting_definitions(spark):
    now = instant("2030-01-01")
    table = spark.createDataFrame([], "name string, version int, definition_json string, comment string, created_at timestamp")
    for expected in (1, 2):
        saved = save_definition(table, Definition("file-ingestion", (Step("ingest.store"),)), now)
        assert saved.first()["version"] == expected
        table = table.unionByName(saved)
    table = table.unionByName(reset_definition(table, "file-ingestion", now))
    newest = load_definition(table, "file-ingestion")
    assert newest.version == 3 and [s.activity for s in newest.steps][0] == "ingest.fetch"
    with pytest.raises(LookupError):
        reset_definition(table, "unheard-of", now)


def test_unknown_types_refuse_the_job(spark):
    with pytest.raises(ValueError, match="Unknown sensor types: nope"):
        plan_job(measurements(spark, [(1, "co2", "s", 1.0)]), "job", sensor_types=["co2", "nope"])


def test_definition_errors(spark):
    wrong = Definition("file-ingestion", (Step("ingest.fetch"), Step("processing.categorize")))
    numbers = Definition("processing-x", (Step("processing.cleanup", max_attempts=-1), Step("processing.cleanup", timeout_seconds=0), Step("nope", heartbeat_timeout_seconds=-1)))
    rows = [(d.name, d.version, to_json(d)) for d in (wrong, numbers, SENSOR_PROCESSING, Definition("empty", ()))]
    table = decode_definitions(spark.createDataFrame(rows, "name string, version int, definition_json string"))
    errors = {}
    for r in definition_errors(table).orderBy("name", "position").collect():
        errors.setdefault(r["name"], []).append(r["error"])
    assert errors["file-ingestion"] == ["Unknown step 'processing.categorize'. Allowed: ingest.fetch, ingest.validate, ingest.convert, ingest.store"]
    assert errors["empty"] == ["A pipeline needs at least one step"]
    assert len(errors["processing-x"]) == 4 and "sensor-processing" not in errors
