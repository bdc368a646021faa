import pytest
from pyspark.sql import functions as F

from fieldgauge.functions.numbers import mean4, parse_number, round4
from fieldgauge.functions.text import number_text, relative_key, size_text_bytes, trim_blank
from fieldgauge.functions.times import instant, parse_timestamp
from fieldgauge.operators.rules import validate_rows
from fieldgauge.operators.verdicts import file_profile
from fieldgauge.plans.ingest import plan_load
from fieldgauge.plans.steps import FILE_INGESTION, Definition, Step
from fieldgauge.sources.drop_files import detect_format, fetch, parse_rows

HEADER = "sensor_id,sensor_type,timestamp,value,unit\n"
AS_OF = "2030-01-01"


# Fixed values in the tests below: golden readings and exact messages.

def files_of(spark, **contents):
    rows = [(name.replace("__", "."), bytearray(c if isinstance(c, bytes) else c.encode())) for name, c in contents.items()]
    return spark.createDataFrame(rows, "file_key string, content binary").select(
        "file_key", F.octet_length("content").cast("bigint").alias("size_bytes"), "content"
    )


def checked(spark, **contents):
    rows = validate_rows(parse_rows(fetch(files_of(spark, **contents))), instant(AS_OF))
    return [r.asDict() for r in rows.orderBy("file_key", "line_number").collect()]


def fatal(spark, name, content):
    (row,) = checked(spark, **{name: content})
    assert not row["is_row"]
    return row["file"]["fatal_error"]


def test_csv_golden_values(spark):
    text = HEADER + "t-1,temperature,2026-01-01T00:00:00Z,68,F\np-1,pressure,2026-01-01T00:00:00Z,101.3,kPa\nh-1,humidity,2026-01-01T00:00:00Z,0.5,ratio\n"
    rows = [r for r in checked(spark, a__csv=text) if r["is_row"]]
    assert [(r["line_number"], r["value"], r["unit"]) for r in rows] == [(2, 20.0, "C"), (3, 1013.0, "hPa"), (4, 50.0, "%")]


def test_csv_golden_issues(spark):
    lines = ["t-1,temperature,2026-01-01T00:00:00Z,20,C", "t-2,radiation,2026-01-01T00:00:00Z,20,Sv", "t-3,temperature,not-a-date,20,C",
             "t-4,temperature,2026-01-01T00:00:00Z,999,C", "t-5,temperature,2026-01-01T00:00:00Z,20,parsec"]
    rows = [r for r in checked(spark, a__csv=HEADER + "\n".join(lines)) if r["is_row"]]
    assert [(r["line_number"], r["message"]) for r in rows] == [
        (2, None),
        (3, "Unknown sensor_type 'radiation'"),
        (4, "Invalid timestamp 'not-a-date'"),
        (5, "Value 999C outside [-90, 150]"),
        (6, "Unit 'parsec' not supported for temperature"),
    ]


@pytest.mark.parametrize(
    "content, error",
    [
        ("", "Empty file"),
        ("   \nx", "Empty file"),
        ("id;type\n1;2", "Invalid header 'id;type', expected 'sensor_id,sensor_type,timestamp,value,unit'"),
    ],
)
def test_csv_fatal(spark, content, error):
    assert fatal(spark, "a__csv", content) == error


def test_json_golden_value(spark):
    text = '[{"sensorId":"c-1","sensorType":"co2","timestamp":"2026-01-01T00:00:00Z","value":0.1,"unit":"%"}]'
    (row,) = checked(spark, a__json=text)
    assert (row["line_number"], row["value"], row["unit"], row["message"]) == (1, 1000.0, "ppm", None)


@pytest.mark.parametrize(
    "content, error",
    [
        ("{ not json", "Invalid JSON"),
        ("", "Invalid JSON"),
        ("[1] x", "Invalid JSON"),
        ("[1],[2]", "Invalid JSON"),
        ('[{"value":NaN}]', "Invalid JSON"),
        ('[{"value":1}', "Invalid JSON"),
        ("[1,]", "Invalid JSON"),
        ('{"a":1}', "JSON root must be an array"),
        ("null", "JSON root must be an array"),
        ('"x"', "JSON root must be an array"),
    ],
)
def test_json_fatal(spark, content, error):
    assert fatal(spark, "a__json", content) == error


def test_json_kinds(spark):
    good = '"sensorType":"co2","timestamp":"2026-01-01T00:00:00Z","unit":"ppm"'
    items = ["7", "null", f'{{"sensorId":5,{good},"value":"400"}}', f'{{"sensorId":true,{good},"value":400}}', f'{{"SensorId":"x",{good},"value":400}}',
             f'{{"sensorId":"a","sensorId":"b",{good},"value":400}}', f'{{"sensorId":"a",{good},"value":[1]}}', f'{{"sensorId":null,{good},"value":1}}']
    rows = checked(spark, a__json="[" + ",".join(items) + "]")
    need = "sensor_id is required (max 64 chars)"
    assert [r["message"] for r in rows] == ["Item is not an object", "Item is not an object", None, need, need, None, "Invalid value ''", need]
    assert [r["sensor_id"] for r in rows if r["message"] is None] == ["5", "b"]
    assert [r["line_number"] for r in rows] == list(range(1, 9))


def test_line_ends_marks_and_blanks(spark):
    row = "\tt-1 ,TEMPERATURE, 2026-01-01T00:00:00Z ,\t20 ,c"
    crlf, bare = f" Sensor_ID ,sensor_type,timestamp,value,UNIT\r\n{row}\r\n\r\n  \r\n{row}", HEADER.replace("\n", "\r") + f"{row}\r{row}\r"
    rows = [r for r in checked(spark, a__csv=b"\xef\xbb\xbf" + crlf.encode(), b__csv=bare) if r["is_row"]]
    assert [(r["file_key"], r["line_number"], r["message"]) for r in rows] == [("a.csv", 2, None), ("a.csv", 5, None), ("b.csv", 2, None), ("b.csv", 3, None)]
    assert {(r["sensor_id"], r["sensor_type"], r["unit"]) for r in rows} == {("t-1", "temperature", "C")}


def test_first_failing_rule_wins(spark):
    lines = [" ,radiation,x,y,z", "a" * 65 + ",co2,2026-01-01,1,ppm", "a,radiation,x,y,z", "a,co2,x,y,z", "a,co2,2999-01-01,y,z", "a,co2,2026-01-01,y,z",
             "a,co2,2026-01-01,1,z", "a,co2,2026-01-01,-1,ppm", "a,co2,2026-01-01,1", "a,co2,2026-01-01,0,ppm", "a,co2,2026-01-01,10000.00004,ppm"]
    rows = [r for r in checked(spark, a__csv=HEADER + "\n".join(lines)) if r["is_row"]]
    assert [r["message"] for r in rows] == [
        "sensor_id is required (max 64 chars)", "sensor_id is required (max 64 chars)", "Unknown sensor_type 'radiation'", "Invalid timestamp 'x'",
        "Timestamp '2999-01-01' is in the future", "Invalid value 'y'", "Unit 'z' not supported for co2", "Value -1ppm outside [0, 10000]",
        "Expected 5 fields, got 4", None, None,
    ]


def test_future_guard_is_one_day(spark):
    lines = ["a,co2,2030-01-02T00:00:00Z,1,ppm", "a,co2,2030-01-02T00:00:01Z,1,ppm", "a,co2,2030-01-02T02:00:00+02:00,1,ppm"]
    rows = [r for r in checked(spark, a__csv=HEADER + "\n".join(lines)) if r["is_row"]]
    assert [r["message"] is None for r in rows] == [True, False, True]


def test_scalars(spark):
    def one(column, *values):
        frame = spark.createDataFrame([(v,) for v in values], "x string")
        return [r[0] for r in frame.select(column(F.col("x"))).collect()]

    texts = ["1", " +1.5e2 ", "1.", ".5", "1d", "1f", "NaN", "Infinity", "1e400", "", "0x1", "1,5", " 7 ", "--1"]
    assert one(parse_number, *texts) == [1.0, 150.0, 1.0, 0.5, None, None, None, None, None, None, None, None, 7.0, None]
    assert one(trim_blank, "\t a b 　", "x") == ["a b", "x"]
    stamps = one(parse_timestamp, "2026-01-01", "2026", " 2026-01-01T00:00:00+02:00 ", "01/02/2026", "2026-13-01", "T12:00")
    assert [s is not None for s in stamps] == [True, False, True, False, False, False]
    assert one(lambda x: number_text(x.cast("double")), "20", "0.5", "-90", "1e15", "123456789.25", "0", "2.5e300") == ["20", "0.5", "-90", "1E+15", "123456789.25", "0", "2.5E+300"]
    assert one(lambda x: round4(x.cast("double")), "0.00005", "0.00025", "1.23456") == [0.0, 0.0002, 1.2346]
    assert one(relative_key, "incoming/a/b.csv", "a/b.csv", "processed/incoming/x", "incomings/x") == ["a/b.csv", "a/b.csv", "incoming/x", "incomings/x"]
    assert one(size_text_bytes, "12 MB", "1 kB", "3 XB", "x MB") == [12 * 1024.0**2, 1024.0, 3.0, None]
    assert one(detect_format, "a.CSV", "a.b/x.json", "x.csv.txt", "csv", "a.csv/x") == ["csv", "json", "unknown", "unknown", "unknown"]


def test_mean_is_exact_on_ties(spark):
    values = [2.76, 100.15, 13.42, 8.01, 0.5, 44.44, 91.18, 8.03]
    frame = spark.createDataFrame([(v,) for v in values], "value double")
    cents = sum(round(v * 100) for v in values)
    assert frame.select(mean4(F.col("value"))).first()[0] == round(cents * 100 / len(values)) / 10000
    fine = spark.createDataFrame([(1 / 3,), (1 / 7,)], "value double")
    assert fine.select(mean4(F.col("value"))).first()[0] == round((1 / 3 + 1 / 7) / 2, 4)


def verdict(spark, definition=FILE_INGESTION, **contents):
    rows = plan_load(files_of(spark, **contents), instant(AS_OF), definition).verdicts.collect()
    return {r["file_key"]: r for r in rows}


GOOD, BAD = "a,co2,2026-01-01,400,ppm\n", "a,co2,2026-01-01,-1,ppm\n"


def ingestion(*steps):
    return Definition("file-ingestion", steps, 7)


def test_verdict_order_and_limits(spark):
    small = ingestion(Step("ingest.fetch", parameters={"maxBytes": "100"}), Step("ingest.validate", parameters={"maxRows": "1"}), Step("ingest.store"))
    found = verdict(spark, small, big__csv=HEADER + GOOD * 9, two__csv=HEADER + GOOD * 2, one__csv=HEADER + GOOD, none__csv=HEADER, odd__txt="x")
    assert (found["big.csv"]["error_type"], found["big.csv"]["error"]) == ("FileTooLarge", f"File is {len(HEADER) + 9 * len(GOOD)} bytes, max 100")
    assert (found["big.csv"]["failed_step"], found["big.csv"]["checksum"]) == ("ingest.fetch", None)
    assert (found["two.csv"]["error_type"], found["two.csv"]["error"]) == ("InvalidFile", "Too many rows (max 1)")
    assert found["none.csv"]["error"] == "File contains no data row"
    assert found["odd.txt"]["error"] == "Unsupported format 'unknown'"
    assert (found["one.csv"]["status"], found["one.csv"]["stored_count"], found["one.csv"]["row_count"]) == ("Stored", 1, 1)


def test_invalid_ratio_is_exclusive(spark):
    text = HEADER + GOOD * 3 + BAD
    at = lambda ratio: ingestion(Step("ingest.validate", parameters={"maxInvalidRowRatio": ratio}), Step("ingest.store"))
    assert verdict(spark, at("0.25"), a__csv=text)["a.csv"]["status"] == "Stored"
    row = verdict(spark, at("0.2"), a__csv=text)["a.csv"]
    assert row["error"] == "1/4 invalid rows (max ratio 0.2): line 5: Value -1ppm outside [0, 10000]"
    assert (row["error_type"], row["row_count"], row["invalid_row_count"]) == ("InvalidRows", 0, 0)
    assert verdict(spark, at("nonsense"), a__csv=text)["a.csv"]["error_type"] == "InvalidRows"


def test_disabled_validation_stores_what_is_valid(spark):
    steps = ingestion(Step("ingest.fetch"), Step("ingest.validate", enabled=False), Step("ingest.store"))
    found = verdict(spark, steps, a__csv=HEADER + GOOD + BAD, b__csv=HEADER + BAD, c__csv="id;type\n")
    assert (found["a.csv"]["status"], found["a.csv"]["stored_count"], found["a.csv"]["row_count"]) == ("Stored", 1, 0)
    assert [found[k]["error"] for k in ("b.csv", "c.csv")] == ["No valid measurement to store"] * 2
    assert found["a.csv"]["completed_steps"] == ["ingest.fetch", "ingest.store"]
    assert found["b.csv"]["completed_steps"] == ["ingest.fetch"]


def test_issue_sample_is_capped_but_count_is_not(spark):
    row = verdict(spark, a__csv=HEADER + BAD * 80)["a.csv"]
    assert len(row["issues"]) == 50 and [i["line_number"] for i in row["issues"]][:2] == [2, 3]
    assert row["error"].startswith("80/80 invalid rows (max ratio 0): line 2: ") and row["error"].count(" | ") == 4


def test_summary_counts_marker_rows_as_none(spark):
    rows = validate_rows(parse_rows(fetch(files_of(spark, a__csv=HEADER, b__json="[]", c__csv=HEADER + GOOD + BAD))), instant(AS_OF))
    counts = {r["file_key"]: (r["total_rows"], r["invalid_rows"], r["valid_rows"]) for r in file_profile(rows).collect()}
    assert counts == {"a.csv": (0, 0, 0), "b.json": (0, 0, 0), "c.csv": (2, 1, 1)}
