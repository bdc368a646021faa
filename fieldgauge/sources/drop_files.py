"""Drop-folder files: fetch, format, and parsing of CSV and JSON content into rows.

Everything is one map-side pass over the files: content never goes through a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, trim_blank
from .listing import key_under, visible_objects

# The header of a CSV file and the property names of a JSON item.
CSV_HEADER = ["sensor_id", "sensor_type", "timestamp", "value", "unit"]
JSON_NAMES = ["sensorId", "sensorType", "timestamp", "value", "unit"]

MAX_BYTES = 50 * 1024 * 1024
LINE_BREAK = "\r\n|\r|\n"
BYTE_ORDER_MARK = "\ufeff"
FILE_COLUMNS = ["size_bytes", "checksum", "format", "fatal_error"]


def load_of(rows: DataFrame) -> list[str]:
    """The column that tells loads apart, where rows of several loads go through one pass."""
    return ["load"] if "load" in rows.columns else []


def detect_format(key: Column) -> Column:
    extension = F.lower(F.regexp_extract(key, r"(\.[^./]*)$", 1))
    return F.when(extension == ".csv", "csv").when(extension == ".json", "json").otherwise("unknown")


def as_files(scan: DataFrame, root: str, key_of: Callable[[Column], Column] | None = None, max_bytes: int | None = None, parts: int | None = None) -> DataFrame:
    """A binaryFile scan as (file_key, size_bytes, last_modified, content, path), keys relative to root.

    Files over max_bytes come without content: the limit is pushed to the scan, which then
    does not open them. key_of turns the relative path into the key where they differ, as
    where a writer makes a folder per object. A scan takes at most `parts` tasks.
    """
    fewer = lambda rows: rows if parts is None else rows.coalesce(parts)
    columns = ["path", "modificationTime", "length"]
    if max_bytes is not None:
        large = scan.where(F.col("length") > max_bytes).select(*columns, F.lit(None).cast("binary").alias("content"))
        scan = fewer(scan.where(F.col("length") <= max_bytes).select(*columns, "content")).unionByName(fewer(large))
    else:
        scan = fewer(scan)
    files = scan.select(
        key_under(root, F.col("path")).alias("key"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        "content",
        "path",
    )
    key = key_of(F.col("key")) if key_of else F.col("key")
    return visible_objects(files).select(key.alias("file_key"), "size_bytes", "last_modified", "content", "path")


def fetch(files: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Add checksum and format. Content over the limit is dropped before it is hashed."""
    content = F.when(F.col("size_bytes") <= max_bytes, F.col("content")) if max_bytes is not None else F.col("content")
    return files.select(
        "file_key",
        *load_of(files),
        "size_bytes",
        F.sha2(content, 256).alias("checksum"),
        detect_format(F.col("file_key")).alias("format"),
        content.alias("content"),
    )


def parse_rows(fetched: DataFrame) -> DataFrame:
    """One row per data row of a file, and one marker row where a file has no data row.

    Columns: file_key, file (size, checksum, format and fatal error as one struct, so that a
    row carries one column for them), is_row, line_number, the five raw fields as text and
    row_error. A marker row has is_row = false. Where several loads are parsed together, their rows keep load.
    """
    loads = load_of(fetched)
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.startswith(decoded, F.lit(BYTE_ORDER_MARK)), F.substring(decoded, 2, 2**31 - 1)).otherwise(decoded)
    is_csv, is_json = F.col("format") == "csv", F.col("format") == "json"
    # Wrapping the document in an array makes trailing text after the root an error.
    wrapped = F.try_parse_json(F.when(is_json, F.concat(F.lit("["), F.col("_text"), F.lit("]"))))
    staged = (
        fetched.withColumn("_text", text)
        .withColumn("_lines", F.when(is_csv, F.split("_text", LINE_BREAK)))
        .withColumn("_roots", wrapped.try_cast("array<variant>"))
        .withColumn("_header", F.when(is_csv, F.element_at("_lines", 1)))
        .withColumn("_root_ok", F.coalesce(F.size("_roots") == 1, F.lit(False)))
        .withColumn("_items", F.when(F.col("_root_ok"), F.element_at("_roots", 1)).try_cast("array<variant>"))
    )
    header_names = F.transform(F.split("_header", ","), lambda name: F.lower(trim_blank(name)))
    expected = ",".join(CSV_HEADER)
    fatal = (
        F.when(F.col("content").isNull(), F.lit(None).cast("string"))
        .when(is_csv & ~has_text(F.col("_header")), "Empty file")
        .when(
            is_csv & (header_names != F.array(*map(F.lit, CSV_HEADER))),
            F.concat(F.lit("Invalid header '"), F.col("_header"), F.lit(f"', expected '{expected}'")),
        )
        .when(is_json & ~F.col("_root_ok"), "Invalid JSON")
        .when(is_json & F.col("_items").isNull(), "JSON root must be an array")
        .when(~is_csv & ~is_json, F.concat(F.lit("Unsupported format '"), F.col("format"), F.lit("'")))
    )
    staged = staged.withColumn("fatal_error", fatal)
    good = F.col("fatal_error").isNull()
    # Exactly one of the two lists is set, so the two generators never multiply.
    exploded = (
        staged.select(
            "file_key",
            *loads,
            F.struct(*FILE_COLUMNS).alias("file"),
            F.when(good, F.col("_lines")).alias("_lines"),
            F.when(good, F.col("_items")).alias("_items"),
        )
        .select("file_key", *loads, "file", "_items", F.posexplode_outer("_lines").alias("_line_pos", "_line"))
        # The header stays as the marker row of its file.
        .where(F.col("_line_pos").isNull() | (F.col("_line_pos") == 0) | has_text(F.col("_line")))
        .select("file_key", *loads, "file", "_line_pos", "_line", F.posexplode_outer("_items").alias("_item_pos", "_item"))
    )
    return _fields(exploded)


def _fields(exploded: DataFrame) -> DataFrame:
    loads = load_of(exploded)
    from_csv = F.col("_line_pos") > 0
    from_json = F.col("_item_pos").isNotNull()
    members = F.array(*[F.col("_object")[name] for name in JSON_NAMES])
    parts = exploded.withColumn("_object", F.when(from_json, F.col("_item").try_cast("map<string,variant>"))).select(
        "file_key",
        *loads,
        "file",
        F.coalesce(from_csv | from_json, F.lit(False)).alias("is_row"),
        (F.coalesce("_line_pos", "_item_pos") + 1).cast("int").alias("line_number"),
        F.when(from_csv, F.split("_line", ","))
        .when(from_json & F.col("_object").isNotNull(), F.transform(members, _scalar_text))
        .alias("_parts"),
    )
    width = len(CSV_HEADER)
    row_error = F.when(F.col("is_row") & F.col("_parts").isNull(), "Item is not an object").when(
        F.size("_parts") != width, F.concat(F.lit(f"Expected {width} fields, got "), F.size("_parts").cast("string"))
    )
    fields = [F.get("_parts", F.lit(i)).alias(name) for i, name in enumerate(CSV_HEADER)]
    return parts.select("file_key", *loads, "file", "is_row", "line_number", *fields, row_error.alias("row_error"))


def _scalar_text(member: Column) -> Column:
    """Text of a JSON string or number; any other kind, or a missing member, reads as ''."""
    scalar = F.schema_of_variant(member).rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.coalesce(F.when(scalar, member.try_cast("string")), F.lit(""))


def parse_csv(files: DataFrame) -> DataFrame:
    """Data rows of the CSV files only."""
    return parse_rows(fetch(files, None).where(F.col("format") == "csv")).where("is_row")


def parse_json(files: DataFrame) -> DataFrame:
    """Data rows of the JSON files only."""
    return parse_rows(fetch(files, None).where(F.col("format") == "json")).where("is_row")
