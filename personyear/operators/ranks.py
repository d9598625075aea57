"""Running totals and positions over a whole table, without a whole-table window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running_before(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Add the total weight of all rows that come earlier in ``order``.

    Rows are sorted into ranges and written with the number of their range.  A
    row's total is that of the ranges before its own plus a running sum inside
    it, so no task holds more than a range, and one row per range meets at the
    end.  ``order`` must be free of ties.
    """
    ranged = written(
        df.repartitionByRange(*order).withColumns({"__range": F.spark_partition_id(), "__weight": weight}),
        "ranges",
    )
    inside = Window.partitionBy("__range").orderBy(*order)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__range")
        .agg(F.sum("__weight").alias("__total"))
        .select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    )
    return (
        ranged.join(offsets, "__range")
        .withColumn(name, F.col("__offset") + F.sum("__weight").over(inside) - F.col("__weight"))
        .drop("__range", "__weight", "__offset")
    )
