"""Projections: choose, rename, fold and recode columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, column


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefix)]


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*with_prefix(df, prefix))


def clean_names(names: list[str]) -> list[str]:
    """Lower case, no punctuation, underscores for blanks, repeats numbered."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        plain = re.sub(r"[!-/:-@\[-`{-~]", "", name.lower()).replace(" ", "_")
        count = seen.get(plain, 0)
        seen[plain] = count + 1
        result.append(plain if count == 0 else f"{plain}.{count}")
    return result


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def apply_to(df: DataFrame, names: list[str], function: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to many columns."""
    return df.withColumns({name: function(F.col(name)) for name in names})


def fold_case(df: DataFrame, names: list[str]) -> DataFrame:
    return apply_to(df, names, F.lower)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first non-null among the variants of a column that this frame has."""
    present = [F.col(f"`{name}`") for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def banded(
    df: DataFrame,
    band: ColumnLike,
    choices: list[tuple[int, int, Column | str]],
) -> Column:
    """Pick a source column by the range its year falls in; outside all ranges NULL.

    A choice that names a column the frame lacks is NULL in its range.
    """
    result = None
    for low, high, choice in choices:
        known = not isinstance(choice, str) or choice in df.columns
        value = column(choice) if known else F.lit(None).cast("string")
        inside = column(band).between(low, high)
        result = F.when(inside, value) if result is None else result.when(inside, value)
    return result


def recode_sets(value: ColumnLike, codes: dict[str, list[str]], default: Column | None = None) -> Column:
    """New value per set of old values, NULL (or ``default``) for all others."""
    result = None
    for new, old in codes.items():
        hit = column(value).isin(old)
        result = F.when(hit, new) if result is None else result.when(hit, new)
    return result if default is None else result.otherwise(default)


def recode_exact(df: DataFrame, name: str, mapping: dict[str, str]) -> DataFrame:
    """Replace listed values, keep all others; the list is hash-joined, not a CASE chain.

    The list stands in the calling code, so its size is bounded.
    """
    lookup = df.sparkSession.createDataFrame(list(mapping.items()), "__old string, __new string")
    return (
        df.join(F.broadcast(lookup), F.col(name) == F.col("__old"), "left")
        .withColumn(name, F.coalesce("__new", name))
        .drop("__old", "__new")
    )


def code_titles(df: DataFrame, name: str, codes: DataFrame, code: str, title: str) -> DataFrame:
    """Attach titles from a code table, NULL for unknown codes."""
    lookup = codes.select(F.col(code).alias("__code"), F.col(title))
    return df.join(lookup, F.col(name) == F.col("__code"), "left").drop("__code")
