"""Text helpers: trimming, keys, labels and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The life-cycle prefixes of a file key.
LIFECYCLE_PREFIXES = ["incoming/", "processing/", "processed/", "invalid/", "converted/"]

# The Unicode White_Space characters.
WHITE_SPACE = "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

# Bytes per unit of a size text; an unknown unit counts as 1.
SIZE_UNITS = {"bytes": 1, "kB": 1024, "MB": 1024**2, "GB": 1024**3}


def trim_blank(text: Column) -> Column:
    """Strip every Unicode blank; Spark's plain trim strips the space only."""
    return F.when(text.rlike("^[!-~]+$"), text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def has_text(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def relative_key(key: Column) -> Column:
    """The key without its life-cycle prefix."""
    names = "|".join(p.rstrip("/") for p in LIFECYCLE_PREFIXES)
    return F.regexp_replace(key, f"^({names})/", "")


def lifecycle_prefix(key: Column) -> Column:
    """The life-cycle prefix of a key, '' when it has none."""
    names = "|".join(p.rstrip("/") for p in LIFECYCLE_PREFIXES)
    return F.regexp_extract(key, f"^((?:{names})/)", 1)


def derived_key(prefix: str, relative: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), relative, F.lit(suffix))


def converted_key(relative: Column) -> Column:
    return derived_key("converted/", relative, ".ndjson")


def error_report_key(relative: Column) -> Column:
    return derived_key("invalid/", relative, ".error.json")


def truncate(text: Column, length: int = 2000) -> Column:
    return F.substring(text, 1, length)


def size_text_bytes(text: Column) -> Column:
    """'12 MB' to a number of bytes."""
    parts = F.split(F.trim(text), r"\s+")
    unit = F.try_element_at(parts, F.lit(2))
    factor = F.lit(1)
    for name, size in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    return F.try_element_at(parts, F.lit(1)).try_cast("double") * factor


def definition_kind(name: Column) -> Column:
    """Which step catalog a definition name belongs to."""
    return F.when(name.startswith("sensor-processing") | name.startswith("processing"), "processing").otherwise("ingestion")


def job_key(base: Column | str, sensor_type: Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat_ws("-", base, sensor_type)


def zero_padded(number: Column, width: int) -> Column:
    """At least width digits; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def file_name(number: Column) -> Column:
    return F.concat(F.lit("file-"), zero_padded(number, 6))


def number_text(value: Column) -> Column:
    """Shortest text of a double: 20 and 0.5, not 20.0; exponents only from 1E+15 on."""
    plain = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), r"E(\d)", "E+$1")
    return F.when(F.abs(value) < 1e15, plain).otherwise(exponent)


def plain_number(value: float) -> str:
    """The same text for a parameter on the driver."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))
