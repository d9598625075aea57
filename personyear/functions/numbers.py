"""Numbers held in text, rounding, and school years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, column, extract

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def to_number(value: ColumnLike) -> Column:
    """Text to double, NULL when it does not hold a number."""
    source = column(value)
    return F.when(source.rlike(NUMBER), F.trim(source).try_cast("double"))


def parse_money(value: ColumnLike) -> Column:
    """As :func:`to_number`, after dropping dollar signs and thousands commas."""
    return to_number(F.regexp_replace(column(value).cast("string"), "[$,]", ""))


def to_boolean(value: ColumnLike) -> Column:
    return column(value).try_cast("boolean")


def half_even(value: ColumnLike, digits: int = 0) -> Column:
    """Round ties to even on the binary value; ``bround`` rounds its decimal print-out."""
    scale = F.lit(10.0**digits)
    return F.rint(column(value) * scale) / scale


def half_even_bucket(value: ColumnLike, width: int) -> Column:
    """Round to the nearest multiple of ``width``, ties to the even multiple."""
    return F.rint(column(value) / F.lit(float(width))) * F.lit(float(width))


def scaled_text(value: ColumnLike, factor: float) -> Column:
    """Multiply a number held in text and write it back as short text."""
    scaled = to_number(value) * F.lit(factor)
    whole = scaled == F.floor(scaled)
    return F.when(whole, scaled.cast("long").cast("string")).otherwise(scaled.cast("string"))


def spring_year(day: ColumnLike, first_month: int = 7) -> Column:
    """The calendar year in which the school year holding ``day`` ends."""
    date = column(day)
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)


def school_year_label(year: ColumnLike, sep: str = "_") -> Column:
    spring = column(year).cast("long")
    return F.concat_ws(sep, (spring - 1).cast("string"), spring.cast("string"))


def fiscal_file_year(name: ColumnLike) -> Column:
    """``FY07`` in a file name stands for the school year that ends in 2008."""
    return F.lit(2001) + extract(name, r"FY(\d\d)", 1).try_cast("int")


def leading_file_year(name: ColumnLike) -> Column:
    """Four leading digits; one more if a dash shows that the name is a range."""
    source = column(name)
    first = extract(source, r"^(\d{4})", 1).try_cast("int")
    ranged = (F.substring(source, 5, 1) == "-") | (F.substring(source, 6, 1) == "-")
    return first + F.when(ranged, 1).otherwise(0)
