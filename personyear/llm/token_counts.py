"""Token counts through a digest cache.

A text is known by the SHA-256 of its content (null counts as empty), a tokenizer
by the SHA-256 of its file with the library's name.  Counts are stored under both.
Only distinct contents that the cache lacks are encoded, and then appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Bytes of text that the library gets at once.
CALL_BYTES = 1 << 20


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer's version: its file and the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        return hashlib.sha256(library.encode() + b"\0" + file.read()).hexdigest()


def _counter(path: str):
    """A function from texts to their token counts, without added special tokens."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """``digest, n_tokens`` of ``digest, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            sizes = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
            first = 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + CALL_BYTES, side="right")))
                part = batch.slice(first, last - first)
                found = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["digest", "n_tokens"])
                first = last

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` stored for a tokenizer version, once each; a cache that is not there yet is empty."""
    try:
        stored = spark.read.parquet(cache).where(F.col("tokenizer") == version)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    # Two jobs may have stored the same content at the same time, with the same count.
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes, n_tokens, over_limit``.

    ``cache`` is a folder of the shared store; contents that it lacks for this
    tokenizer are counted once each and appended before the result is read from it.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    # Copies fall together before the shuffle, then what is stored falls out.
    distinct = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version), "digest", "left_anti")
    _encoded(misses, tokenizer).withColumn("tokenizer", F.lit(version)).write.partitionBy("tokenizer").mode("append").parquet(cache)
    keyed = docs.select(F.col(id_col), digest, F.octet_length(text).cast("long").alias("n_bytes"))
    counted = keyed.join(read_cache(spark, cache, version), "digest")
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
