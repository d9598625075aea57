"""Unions, distinct reference rows, schema differences, and group samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def union_labeled(frames: dict[str, DataFrame], label: str | None = None) -> DataFrame:
    """Unite by name, NULL for absent columns, optionally tagged with the frame's key."""
    tagged = [
        frame if label is None else frame.select(F.lit(key).alias(label), "*")
        for key, frame in frames.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_dimension(
    dim: DataFrame, keep: Column | None, fold: dict[str, Column], drop: list[str]
) -> DataFrame:
    """Usual preparation of a reference table: filter, fold, project, distinct."""
    kept = dim if keep is None else dim.where(keep)
    return kept.withColumns(fold).drop(*drop).distinct()


def column_table(spark: SparkSession, schemas: dict[str, list[str]]) -> DataFrame:
    """(source, column) rows of the given schemas."""
    rows = [(source, name) for source, names in schemas.items() for name in names]
    return spark.createDataFrame(rows, "source string, column string")


def extra_columns(spark: SparkSession, schemas: dict[str, list[str]], known: list[str]) -> DataFrame:
    """Columns a source offers beyond the known ones."""
    listed = spark.createDataFrame([(name,) for name in known], "column string")
    return column_table(spark, schemas).join(listed, "column", "left_anti").select("source", "column")


def sample_groups(df: DataFrame, group: str, row_key: str, draws: int, seed: int) -> DataFrame:
    """All records of the groups met in a seeded draw of rows.

    Rows are drawn, not groups: a big group is likelier, and may be drawn twice.
    The draw takes the rows with the smallest seeded digest, a distributed top-k.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_key).cast("string")).cast("binary"))
    drawn = (
        df.select(group, digest.alias("__draw"), row_key)
        .orderBy("__draw", row_key)
        .limit(draws)
        .select(group)
        .distinct()
    )
    return df.join(drawn, group, "left_semi").select(*df.columns)
