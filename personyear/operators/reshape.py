"""Wide to long, long to wide, and splitting a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, column
from .project import with_prefix


def unpivot_years(
    df: DataFrame, prefix: str, start: int, length: int, year: str = "year", value: str = "value"
) -> DataFrame:
    """Yearly columns to rows; the year stands at ``start`` of the column name.  NULLs stay."""
    wide = with_prefix(df, prefix)
    keys = [name for name in df.columns if name not in wide]
    return df.unpivot(keys, wide, year, value).withColumn(
        year, F.substring(year, start, length).cast("int")
    )


def unpivot_aliases(df: DataFrame, keys: list[str], aliases: list[str], name: str) -> DataFrame:
    """Alias columns to distinct (key, alias) rows without blanks."""
    long = df.unpivot(keys, aliases, "__from", name).drop("__from")
    return long.where(blank_to_null(F.col(name)).isNotNull()).distinct()


def pivot_values(df: DataFrame, keys: list[str], names: str, values: str, levels: list) -> DataFrame:
    """Long to wide with a stated list of levels, so no extra pass finds them."""
    return df.groupBy(*keys).pivot(names, levels).agg(F.first(values))


def transposed(df: DataFrame, label: str, levels: list[str]) -> DataFrame:
    """A small table of metrics with one column per method."""
    metrics = [name for name in df.columns if name != label]
    typed = df.select(label, *[F.col(name).cast("double").alias(name) for name in metrics])
    long = typed.unpivot([label], metrics, "name", "value")
    return pivot_values(long, ["name"], label, "value", levels)


def split_column(df: DataFrame, name: str, into: list[str], sep: str) -> DataFrame:
    """Split at ``sep``; surplus pieces are dropped and missing ones are NULL."""
    pieces = F.split(column(name), sep)
    kept = [other for other in df.columns if other != name]
    return df.select(*kept, *[F.get(pieces, F.lit(i)).alias(new) for i, new in enumerate(into)])
