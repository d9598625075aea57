"""Person names to four lower-case parts: first, middle, last, other.

All parsing is done with array expressions, so it stays inside the JVM.  Blank
tokens are skipped and absent parts are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, blank_to_null, column, part, strip_punctuation

# Generational suffixes.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv"]
UPPER_SUFFIXES = ["JR", "SR", "II", "III"]

NAME_FIELDS = ["name_first", "name_middle", "name_last", "name_other"]


def _tokens(text: Column) -> Column:
    words = F.transform(F.split(text, " "), strip_punctuation)
    return F.filter(words, lambda word: word != "")


def _spaced(tokens: Column) -> Column:
    return F.nullif(F.array_join(tokens, " "), F.lit(""))


def split_suffixes(tokens: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """(suffix tokens, all other tokens), each in their order."""
    return (
        F.filter(tokens, lambda word: word.isin(suffixes)),
        F.filter(tokens, lambda word: ~word.isin(suffixes)),
    )


def _record(first: Column, middle: Column, last: Column, other: Column) -> Column:
    return F.struct(
        first.alias("name_first"),
        middle.alias("name_middle"),
        last.alias("name_last"),
        other.alias("name_other"),
    )


def first_middle_last(value: ColumnLike, suffixes: list[str] = SUFFIXES) -> Column:
    """``John J.P. Jones Jr`` to john / jp / jones / jr."""
    other, kept = split_suffixes(_tokens(F.lower(column(value))), suffixes)
    size = F.size(kept)
    return _record(
        F.get(kept, F.lit(0)),
        F.when(size > 2, _spaced(F.slice(kept, F.lit(2), F.greatest(size - 2, F.lit(0))))),
        F.get(kept, size - 1),
        _spaced(other),
    )


def last_comma_first_middle(value: ColumnLike, suffixes: list[str] = SUFFIXES) -> Column:
    """``Jones Jr, John J P`` to john / j p / jones / jr; only the first comma counts.

    Without text after a comma everything but suffixes is the last name, and
    the suffixes are not reported.
    """
    text = F.lower(column(value))
    left = F.substring_index(text, ",", 1)
    right = F.replace(F.substring(text, F.length(left) + 2, F.length(text)), F.lit(","), F.lit(" "))
    left_other, left_kept = split_suffixes(_tokens(left), suffixes)
    right_other, right_kept = split_suffixes(_tokens(right), suffixes)
    has_rest = F.size(_tokens(right)) > 0
    return _record(
        F.get(right_kept, F.lit(0)),
        _spaced(F.slice(right_kept, F.lit(2), F.greatest(F.size(right_kept) - 1, F.lit(0)))),
        _spaced(left_kept),
        F.when(has_rest, _spaced(F.concat(left_other, right_other))),
    )


def any_order(value: ColumnLike, suffixes: list[str] = SUFFIXES) -> Column:
    """Choose the parser per row: a comma means that the last name comes first."""
    return F.when(
        column(value).contains(","), last_comma_first_middle(value, suffixes)
    ).otherwise(first_middle_last(value, suffixes))


def split_given(value: ColumnLike, extras: int | None = None) -> tuple[Column, Column]:
    """A first-name field that carries middle names: (first, middle).

    ``extras`` bounds the middle names kept; the others are dropped.
    """
    pieces = F.split(column(value), " ")
    take = F.size(pieces) - 1 if extras is None else F.lit(extras)
    rest = F.slice(pieces, F.lit(2), F.greatest(take, F.lit(0)))
    return F.get(pieces, F.lit(0)), blank_to_null(F.array_join(rest, " "))


def last_suffix_first(value: ColumnLike) -> Column:
    """``Last, suffix, first mi`` where the suffix part may be absent."""
    source = column(value)
    second, third = part(source, ", ", 1), part(source, ", ", 2)
    given = F.replace(F.coalesce(third, second), F.lit("  "), F.lit(" "))
    given = F.replace(F.replace(given, F.lit(" S R"), F.lit(" SR")), F.lit(" J R"), F.lit(" JR"))
    first, middle = split_given(given, 4)
    return _record(first, middle, part(source, ", ", 0), F.when(third.isNotNull(), second))


def last_first_suffix(value: ColumnLike, suffixes: list[str] = UPPER_SUFFIXES) -> Column:
    """``LAST[,SUFFIX],FIRST M`` with the suffix in the second or third part."""
    source = column(value)
    second, third, fourth = (F.trim(part(source, ",", index)) for index in (1, 2, 3))
    other = F.when(second.isin(suffixes), second).when(third.isin(suffixes), third)
    given = F.concat_ws(
        " ",
        F.when(~second.isin(suffixes), second),
        F.when(~third.isin(suffixes), third),
        fourth,
    )
    first, middle = split_given(F.trim(given), 6)
    return _record(first, middle, F.trim(part(source, ",", 0)), other)


def last_first_other(value: ColumnLike) -> Column:
    """``last, first middle, other`` after mending doubled commas."""
    source = F.lower(F.replace(column(value), F.lit(",,"), F.lit(",")))
    given = F.split(F.trim(part(source, ",", 1)), " ", 2)
    return _record(
        blank_to_null(F.get(given, F.lit(0))),
        blank_to_null(F.get(given, F.lit(1))),
        F.trim(part(source, ",", 0)),
        blank_to_null(part(source, ",", 2)),
    )


NAME_FORMATS = {
    "first_middle_last": first_middle_last,
    "last_comma_first_middle": last_comma_first_middle,
    "any_order": any_order,
    "last_suffix_first": last_suffix_first,
    "last_first_suffix": last_first_suffix,
    "last_first_other": last_first_other,
}
