"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes the session, the documents that the stage before kept, and the
folder of tables, and returns a DataFrame; all but the last return the columns of
``documents``.  Stages are written and read again, so each has a short plan and a
lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personyear.llm import buckets, chunks, decontaminate, near_duplicates, toxicity
from personyear.session import new_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _measured_again(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents with ``n_chars`` as their texts are now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return docs.select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    scored = toxicity.toxicity(docs, _table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    found = near_duplicates.near_duplicates(docs)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of passages; one that was nothing else goes."""
    found = chunks.repeated_passages(docs)
    left = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("deduplicated"))
    return _measured_again(left, docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that was nothing else goes."""
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return _measured_again(decontaminate.without_spans(found), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Segments of the remaining documents in length buckets and batches."""
    return buckets.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("packing", pack),
]

#: Nearest neighbours and content-defined chunks have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
