"""Exact quantiles of columns of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running_before


def numeric_summary(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Minimum, quartiles (linear interpolation), mean and maximum.

    The percentile aggregate gathers all distinct values of a group in one
    task.  Here values are counted and ranked by a distributed running sum, and
    quantiles are the largest values that start at or below their ranks.
    """
    keys = by or ["__all"]
    counts = (
        df.withColumn("__all", F.lit(1))
        .where(F.col(name).isNotNull())
        .groupBy(*keys, name)
        .agg(F.count("*").alias("__n"))
    )
    order = [F.col(key) for key in [*keys, name]]
    ranked = running_before(counts, order, F.col("__n"), "__before")
    groups = ranked.groupBy(*keys).agg(
        F.min("__before").alias("__start"),
        F.sum("__n").alias("__rows"),
        F.min(name).alias("minimum"),
        (F.sum(F.col(name) * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.max(name).alias("maximum"),
    )
    # Without grouping the totals are exactly one row.
    totals = groups if by else F.broadcast(groups)
    placed = ranked.withColumnsRenamed({key: f"__by_{key}" for key in keys}).join(
        totals, [F.col(f"__by_{key}").eqNullSafe(F.col(key)) for key in keys]
    )
    ends = {}
    for label, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        at = F.col("__start") + (F.col("__rows") - 1) * F.lit(q)
        low = F.max(F.when(F.col("__before") <= F.floor(at), F.col(name)))
        high = F.max(F.when(F.col("__before") <= F.ceil(at), F.col(name)))
        weight = F.first(at - F.floor(at))
        ends[label] = (low + (high - low) * weight).alias(label)
    summary = ["minimum", "mean", "maximum"]
    return placed.groupBy(*keys).agg(
        *[F.first(column).alias(column) for column in summary], *ends.values()
    ).select(*(by or []), "minimum", "p25", "median", "mean", "p75", "maximum")
