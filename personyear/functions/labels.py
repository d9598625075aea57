"""Classifiers of free-text labels.

A NULL label gives NULL from the keyword and code classifiers and FALSE from
membership, and membership filters keep NULL rows when negated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, column


def member(value: ColumnLike, values: list[str]) -> Column:
    return F.coalesce(column(value).isin(values), F.lit(False))


def not_member(value: ColumnLike, values: list) -> Column:
    return ~F.coalesce(column(value).isin(values), F.lit(False))


def mentions(value: ColumnLike, words: list[str]) -> Column:
    """One pass over the text for any of the literal words."""
    return column(value).rlike("|".join(re.escape(word) for word in words))


def lacks_pattern(value: ColumnLike, pattern: str) -> Column:
    """Case-insensitive exclusion that keeps NULL rows."""
    return ~F.coalesce(column(value).rlike(f"(?i){pattern}"), F.lit(False))


def keyword_flag(
    value: ColumnLike, include: list[str], exclude: list[str], exact: list[str] | None = None
) -> Column:
    """Any included word (or exact label), and none of the excluded words."""
    wanted = mentions(value, include)
    if exact:
        wanted = wanted | member(value, exact)
    return wanted & ~mentions(value, exclude)


def flag_text(flag: Column) -> Column:
    """The panel keeps flags as the texts TRUE and FALSE."""
    return F.when(flag, "TRUE").when(~flag, "FALSE")
