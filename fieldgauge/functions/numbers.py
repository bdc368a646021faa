"""Number helpers: strict parsing, rounding, clamping and parameter look-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE_SPACE

# Fixed value: the accepted shape of a number; a bare cast would also take 1d or NaN.
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def read_number(text: Column) -> Column:
    """Text to a double, NULL where it has not the shape of a number; 1e400 reads as infinite."""
    # Blanks are rare: only text that is not a number as it stands is trimmed.
    trimmed = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double")).when(trimmed.rlike(NUMBER_SHAPE), trimmed.try_cast("double"))


def is_finite(number: Column) -> Column:
    """False for NULL, too."""
    return F.coalesce(F.abs(number) < float("inf"), F.lit(False))


def parse_number(text: Column) -> Column:
    """Text to a finite double, NULL for anything else."""
    number = read_number(text)
    return F.when(is_finite(number), number)


def round4(value: Column) -> Column:
    """Four decimals, ties to even, on doubles."""
    return F.rint(value * 10000) / 10000


def mean4(value: Column) -> Column:
    """Aggregate: the mean to four decimals, ties to even, whatever order rows come in.

    Four-decimal values are added as whole numbers of 1/10000, which is exact. What other
    values have beyond that is added apart; it is zero for stored measurements.
    """
    units = F.rint(value * 10000)
    rest = F.sum(value - units / 10000) * 10000
    return F.rint((F.sum(units.cast("bigint")) + rest) / F.count(value)) / 10000


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, as_column(low)), as_column(high))


def parameter_number(parameters: Column, name: str, fallback: float | int, type_name: str = "double") -> Column:
    """A number out of a string map; missing or unreadable gives the fallback."""
    return F.coalesce(F.try_element_at(parameters, F.lit(name)).try_cast(type_name), F.lit(fallback).cast(type_name))


def merge_counts(left: Column, right: Column) -> Column:
    """Add two count maps key by key."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
