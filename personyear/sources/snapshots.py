"""Stage snapshots, per-state exports, and dictionaries for curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_csv


def save_snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write a stage result; with ``by`` only the partitions present are replaced.

    Rebalancing gives files of even size, whether a partition is big or small.
    """
    source = df.hint("rebalance", *by) if by else df
    output = source.write.mode("overwrite")
    if by:
        output = output.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    output.parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, by: str = "state") -> None:
    """One folder of CSV files per state."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def label_dictionary(df: DataFrame, *labels) -> DataFrame:
    """Distinct label combinations with their number of records."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.mode("overwrite").option("header", True).csv(path)


def read_curated(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """A dictionary edited by hand, as text, cut to its first columns."""
    curated = read_csv(spark, path)
    return curated.select(*curated.columns[:columns])
