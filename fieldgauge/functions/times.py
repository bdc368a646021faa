"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE_SPACE

# Fixed value: an ISO-8601 date must lead; Spark alone would also take a bare year.
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}"
# The same in printable ASCII with no blank at the end: nothing to trim.
PLAIN_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}([ -~]*[!-~])?$"


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to an instant; without a zone it is UTC. NULL for anything else."""
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(text.rlike(PLAIN_DATE_SHAPE), text.try_cast("timestamp")).when(trimmed.rlike(DATE_SHAPE), trimmed.try_cast("timestamp"))


def instant(text: str) -> Column:
    """A timestamp parameter given as text."""
    return F.lit(text).cast("timestamp")


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))


def seconds_of(ts: Column) -> Column:
    """Seconds since the epoch as a double."""
    return F.unix_micros(ts) / 1e6
