"""Packing into optimal length buckets.

Texts are sequences of bytes plus one end mark, cut into segments of at most the
context length, so a histogram of segment lengths has at most that many rows
whatever the size of the input.  Dynamic programming over it chooses the bucket
lengths that give the least padding; inside a bucket, segments in the order of a
digest fill batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from personyear.session import written

CONTEXT = 4096
BUCKETS = 8
BUDGET = 1 << 16
#: Rows that one window of the ranking should hold.
SLICE_ROWS = 200_000


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """``id, segment, start, length``: byte ranges of at most ``context`` tokens; the end mark belongs to the last.

    A null text is empty and gives one segment, its end mark.
    """
    n_tokens = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    last = F.floor((n_tokens - 1) / context).cast("int")
    cut = docs.select(F.col(id_col).cast("long").alias("id"), n_tokens.alias("n"), last.alias("last"))
    cut = cut.withColumn("segment", F.explode(F.sequence(F.lit(0), "last")))
    start = (F.col("segment") * F.lit(context)).cast("long")
    return cut.select("id", "segment", start.alias("start"), F.least(F.lit(context).cast("long"), F.col("n") - start).alias("length"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket lengths with the least padding, by dynamic programming.

    ``best[j]`` is the least sum of padded lengths of the first ``j`` distinct
    lengths; of equal choices the one with the shortest earlier part is taken.
    Fewer distinct lengths than buckets give a bucket each.
    """
    size = len(lengths)
    if size <= buckets:
        return [int(x) for x in lengths]
    total = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    best = np.concatenate(([0], lengths * total[1:]))
    choice = np.zeros((buckets, size + 1), dtype=np.int64)
    for used in range(1, buckets):
        following = np.empty_like(best)
        following[0] = 0
        for j in range(1, size + 1):
            costs = best[:j] + lengths[j - 1] * (total[j] - total[:j])
            choice[used, j] = int(np.argmin(costs))
            following[j] = costs[choice[used, j]]
        best = following
    found, j = [], size
    for used in range(buckets - 1, -1, -1):
        if j:
            found.append(int(lengths[j - 1]))
            j = int(choice[used, j])
    return found[::-1]


def order_key(*columns: Column) -> Column:
    """A digest that orders rows as if at random, the same wherever it is computed."""
    return F.md5(F.concat_ws(":", *(c.cast("string") for c in columns)).cast("binary"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, buckets: int = BUCKETS,
    budget: int = BUDGET, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per segment: id, ``segment, start, length, bucket_length, batch, slot, padding``.

    Every byte of every text is in one segment.  ``bucket_length`` is the length
    the segment is padded to; a batch is ``budget // bucket_length`` consecutive
    segments of its bucket (at least one) and is numbered within it; ``slot`` is
    the place in the batch.  Positions come from counts of slices of the order, so
    no task holds a bucket.  Segments of rows that share id, place and length are
    interchangeable.
    """
    cut = written(segments(docs, id_col, text_col, context), "segments")
    histogram = sorted(cut.groupBy("length").count().collect())
    if not histogram:
        return cut.select(F.col("id").alias(id_col), "segment", "start", "length", *(F.lit(0).cast("long").alias(c) for c in ("bucket_length", "batch", "slot", "padding")))
    lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*histogram, strict=True))
    chosen = boundaries(lengths, counts, buckets)
    bucket = F.lit(chosen[-1]).cast("long")
    for bound in reversed(chosen[:-1]):
        bucket = F.when(F.col("length") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    digits = 2
    while 16**digits * slice_rows < counts.sum():
        digits += 1
    keyed = cut.withColumns({"bucket_length": bucket, "key": order_key(F.col("id"), F.col("segment"))}).withColumn(
        "slice", F.substring("key", 1, digits)
    )
    order = ["key", "id", "segment", "length"]
    inside = Window.partitionBy("bucket_length", "slice").orderBy(*order)
    # One row per bucket and slice: sizes before each slice, one window per bucket.
    earlier = Window.partitionBy("bucket_length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("bucket_length", "slice").count()
    before = sizes.select("bucket_length", "slice", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    ranked = keyed.join(before, ["bucket_length", "slice"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    return ranked.select(
        F.col("id").alias(id_col),
        "segment",
        "start",
        "length",
        "bucket_length",
        F.floor(F.col("rank") / per_batch).alias("batch"),
        (F.col("rank") % per_batch).alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
