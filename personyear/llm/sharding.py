"""Shards by a two-pass external shuffle, with DataFrame functions only.

The first pass scatters records into buckets small enough for a task's memory, by
seeded hashes.  The second reads one bucket at a time, puts it in the order of its
keys, shuffles it (Fisher-Yates) and writes it.

The law is ``key``: the id and the number of shards decide.  Each shard draws a
number for an id and the largest wins, so a further shard only takes rows to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from personyear.session import measured

LAW = "key"
SHARDS = 40
SEED = 7
BUCKET_BYTES = 32 << 20
#: Bytes that a record counts besides its text.
RECORD_BYTES = 16
ADDED = ("shard", "bucket", "place", "grown_shard")


def shard_of(key: Column, shards: int) -> Column:
    """The shard whose draw for the key is the largest (of equal draws the later shard's)."""
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(key, s).alias("draw"), s.alias("shard")),
    )
    return F.array_max(draws)["shard"]


def record_bytes(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + RECORD_BYTES).cast("long")


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> StructType:
    """Write all rows and columns of ``docs`` below ``path``, one folder per shard (clashing columns are replaced).

    Added: ``shard``, ``bucket`` within the shard, ``place`` within the bucket, and
    ``grown_shard``, the shard if there were one more.  A row without id is dealt by
    its text.  The number of buckets follows the bytes of all records, which are
    summed first.  Rows that share id and text are interchangeable.  Returns the
    schema of what was written.
    """
    docs = docs.select([c for c in docs.columns if c not in ADDED])
    total = docs.agg(F.sum(record_bytes(text_col))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), text_col))
    scattered = docs.select(
        F.struct("*").alias("record"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed), key, F.col(text_col)), F.lit(buckets)).cast("int").alias("bucket"),
        key.alias("key"),
        F.xxhash64(text_col).alias("text_key"),
    )
    dealt = scattered.repartition(shards * buckets, "shard", "bucket").sortWithinPartitions("shard", "bucket", "key", "text_key")
    gathered = dealt.groupBy("shard", "bucket").agg(F.collect_list(F.struct("record", "grown_shard")).alias("rows"))
    shuffled = gathered.select("shard", "bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
    placed = shuffled.select("row.record.*", "row.grown_shard", "bucket", "place", "shard")
    placed.write.partitionBy("shard").parquet(path)
    return placed.schema


def read_shards(spark: SparkSession, path: str, schema: StructType, columns: list[Column] | None = None) -> DataFrame:
    """The rows of written shards with ``slot``, their gapless position in the shard.

    ``columns`` are computed first, so that only they and the position meet the sizes
    of the buckets, a row each, which are written so that their true size is known.
    """
    rows = spark.read.schema(schema).parquet(path)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "bucket").count()
    before = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    kept = [F.col(c) for c in rows.columns if c not in ("shard", "bucket", "place")] if columns is None else columns
    rows = rows.select(*kept, F.col("shard").alias("shard"), "bucket", "place")
    return rows.join(measured(before, "before"), ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("place")).drop("before")
