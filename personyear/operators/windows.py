"""Per-person reductions, fills and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured, written
from .joins import attach
from .ranks import running_before


def collapse(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    totals: list[str] | None = None,
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """One row per key: the one whose ``order`` values are largest, NULLs last.

    ``totals`` are summed over the group (a group without a value gives 0),
    ``distinct`` maps new names to columns whose distinct values are counted.
    Everything is one aggregate with map-side combining: a key with very many
    rows shrinks to one row per task before the shuffle.
    End ``order`` with a unique column; ties are broken by the row itself.
    """
    totals, distinct = totals or [], distinct or {}
    others = [name for name in df.columns if name not in keys and name not in totals]
    sort = [value.alias(f"__order{i}") for i, value in enumerate(order)]
    best = F.max(F.struct(*sort, *[F.col(name) for name in others])).alias("__best")
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(f"__sum_{name}") for name in totals]
    counts = [F.count_distinct(column).alias(name) for name, column in distinct.items()]
    folded = df.groupBy(*keys).agg(best, *sums, *counts)
    chosen = [
        F.col(name)
        if name in keys
        else F.col(f"__sum_{name}").alias(name)
        if name in totals
        else F.col(f"__best.{name}").alias(name)
        for name in df.columns
    ]
    return folded.select(*chosen, *distinct)


def fill_both_ways(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Fill NULLs from the nearest earlier value, else from the nearest later one.

    Rows are sorted into ranges of keys and order and written with the number of
    their range, so a key with very many rows lies in many ranges.  A range is filled
    by itself.  Only its first and its last key can lie in others too; for these the
    last value of earlier ranges and the first of later ones are carried in, a row or
    two per range.  Rows equal in keys and order fill each other in any order.
    """
    ranged = written(
        df.repartitionByRange(*keys, *order).withColumns({"__range": F.spark_partition_id(), "__key": F.struct(*keys)}), "ranges"
    )
    limits = ranged.groupBy("__range").agg(F.min("__key").alias("__low"), F.max("__key").alias("__high"))
    limits = limits.select("__range", F.explode(F.array_distinct(F.array("__low", "__high"))).alias("__key"))
    given = F.when(F.col(name).isNotNull(), F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.col(name).alias("__value")))
    edges = ranged.join(
        measured(limits.toDF("__at", "__edge"), "limits"),
        (F.col("__range") == F.col("__at")) & F.col("__key").eqNullSafe(F.col("__edge")),
        "left_semi",
    )
    edges = edges.groupBy("__range", "__key").agg(F.max(given)["__value"].alias("__last"), F.min(given)["__value"].alias("__first"))
    ranges = Window.partitionBy("__key").orderBy("__range")
    carried = edges.select(
        F.col("__range").alias("__at"),
        F.col("__key").alias("__edge"),
        F.last("__last", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    joined = ranged.join(
        measured(carried, "carried"), (F.col("__range") == F.col("__at")) & F.col("__key").eqNullSafe(F.col("__edge")), "left"
    )
    inside = Window.partitionBy("__range", *keys).orderBy(*order)
    return joined.withColumn(
        name,
        F.coalesce(
            F.last(name, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "__before",
            F.first(name, ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "__after",
        ),
    ).select(*df.columns)


def drop_last_period(df: DataFrame, keys: list[str], period: str = "year") -> DataFrame:
    """Remove the last period of each group of an aggregated series."""
    group = Window.partitionBy(*keys)
    return (
        df.withColumn("__last", F.max(period).over(group))
        .where(F.col(period) != F.col("__last"))
        .drop("__last")
    )


def group_index(df: DataFrame, names: list[str], within: list[str], index: str) -> DataFrame:
    """Dense number of each distinct combination, counted separately ``within`` a key.

    Distinct combinations get their position in the sort order of the whole
    table, less the first position of their ``within`` key.
    """
    keys = [*within, *names]
    order = [F.col(name).asc_nulls_last() for name in keys]
    placed = running_before(df.select(*keys).distinct(), order, F.lit(1).cast("long"), "__place")
    first = measured(placed.groupBy(*within).agg(F.min("__place").alias("__first")), "first")
    numbers = attach(placed, first, within).select(
        *keys, (F.col("__place") - F.col("__first") + 1).alias(index)
    )
    return attach(df, numbers, keys)
