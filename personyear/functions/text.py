"""Text expressions with the null and first-match behaviour the jobs rely on."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def replace_first(value: ColumnLike, pattern: str, replacement: str) -> Column:
    """Replace the first match only; ``regexp_replace`` alone replaces every match."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(column(value), f"(?s)^(.*?)(?:{pattern})", "$1" + safe)


def replace_each(value: ColumnLike, pairs: list[tuple[str, str]]) -> Column:
    """Apply literal first-match replacements in order."""
    result = column(value)
    for old, new in pairs:
        result = replace_first(result, re.escape(old), new)
    return result


def remove_words(value: ColumnLike, words: list[str]) -> Column:
    """Delete every occurrence of the given literals, one literal after the other."""
    result = column(value)
    for word in words:
        result = F.replace(result, F.lit(word), F.lit(""))
    return result


def extract(value: ColumnLike, pattern: str, group: int = 0) -> Column:
    """Captured text, NULL where the pattern does not match."""
    source = column(value)
    return F.when(source.rlike(pattern), F.regexp_extract(source, pattern, group))


def strip_punctuation(value: ColumnLike) -> Column:
    return F.regexp_replace(column(value), r"\p{Punct}", "")


def blank_to_null(value: ColumnLike) -> Column:
    return F.nullif(F.trim(column(value)), F.lit(""))


def join_parts(*parts: ColumnLike, sep: str = " ") -> Column:
    """Join the non-null parts; an empty result is NULL."""
    return blank_to_null(F.concat_ws(sep, *[column(part) for part in parts]))


def pad_left(value: ColumnLike, width: int, fill: str = "0") -> Column:
    """Pad short text; longer text is left whole, which ``lpad`` would cut."""
    source = column(value)
    return F.when(F.length(source) < width, F.lpad(source, width, fill)).otherwise(source)


def part(value: ColumnLike, sep: str, index: int) -> Column:
    """Piece ``index`` of a split, NULL past the end."""
    return F.get(F.split(column(value), sep), F.lit(index))


def percent_label(share: ColumnLike, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", column(share) * F.lit(100.0))


def repair_bytes(value: ColumnLike) -> Column:
    """Mend two characters left by a wrongly decoded export: N with tilde, odd blank."""
    return F.translate(column(value), "ÑÊ", "N ")


def prefix_to_suffix(value: ColumnLike, prefix: str, suffix: str) -> Column:
    """``CITY OF X`` becomes ``X CITY``; other text is unchanged."""
    source = column(value)
    rest = F.trim(F.replace(source, F.lit(prefix), F.lit("")))
    return F.when(source.contains(prefix), F.concat_ws(" ", rest, F.lit(suffix))).otherwise(source)
