"""The registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personyear.llm import (
    bm25, buckets, chunks, decontaminate, near_duplicates, pieces, reversed_search, sharding, spelling, sql, token_counts,
    token_files, tool_calls, toxicity,
)
from personyear.session import new_folder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results, others = tool_calls.calls_and_results(_table(spark, folder, "conversations"))
    linked = tool_calls.link_tool_calls(calls, results, tool_calls.SCHEMAS, others)
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(_table(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return buckets.pack(_table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    # A cache of its own, so that each run encodes what its table has.
    cache = new_folder(spark, "token-cache")
    return token_counts.token_counts(_table(spark, folder, "documents"), cache, _tokenizer("piece_bpe_32k.model"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "shards")
    schema = sharding.write_shards(_table(spark, folder, "documents"), path)
    columns = [
        F.col("doc_id"),
        sharding.record_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.col("grown_shard"),
    ]
    placed = sharding.read_shards(spark, path, schema, columns)
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard")


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = chunks.repeated_passages(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", (F.col("n_removed") > 0).alias("repeated"), "spans", F.col("deduplicated").alias("text")
    )


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op12_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = _tokenizer("piece_bpe_32k.model")
    decoded = pieces.decode(pieces.encode(_table(spark, folder, "documents"), model), model)
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return reversed_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_tool_calls": op2_tool_calls,
    "op3_token_files": op3_token_files,
    "op4_search": op4_search,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_spelling": op11_spelling,
    "op12_pieces": op12_pieces,
    "op13_ranked_search": op13_ranked_search,
}

SQL = sql.SQL
