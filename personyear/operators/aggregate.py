"""Counts, rates, profiles and numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(flag: Column) -> Column:
    """Mean of a boolean; NULL flags are left out."""
    return F.avg(flag.cast("int"))


def coverage(name: str) -> Column:
    """Share of rows in which the column is present."""
    return share(F.col(name).isNotNull())


def match_rate(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *[coverage(name).alias(f"rate_{name}") for name in names]
    )


def null_profile(df: DataFrame, group: str | None = None) -> DataFrame:
    """Share of NULLs of every column in one pass, as rows (var[, group], pct_na)."""
    names = [name for name in df.columns if name != group]
    keys = [group] if group else []
    missing = [share(F.col(name).isNull()).alias(name) for name in names]
    wide = df.groupBy(*keys).agg(*missing)
    return wide.unpivot(keys, names, "var", "pct_na")


def null_profile_wide(df: DataFrame, group: str, values: list) -> DataFrame:
    """The grouped profile with one column per listed group value."""
    return null_profile(df, group).groupBy("var").pivot(group, values).agg(F.first("pct_na"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list, other: str = "other") -> DataFrame:
    """Counts of two labels; absent combinations count 0, labels not listed (and NULL) count as ``other``."""
    listed = F.when(F.col(columns).isin(values), F.col(columns).cast("string")).otherwise(other)
    names = [str(value) for value in values] + [other]
    return df.withColumn(columns, listed).groupBy(rows).pivot(columns, names).count().na.fill(0, names)


def top_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """The k most frequent labels, ties in label order, NULL last."""
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), F.col(label).asc_nulls_last())
        .limit(k)
    )
