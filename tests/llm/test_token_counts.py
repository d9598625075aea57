import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from personyear.llm import token_counts
from personyear.session import new_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _expected(rows, path):
    if path == PIECES:
        model = SentencePieceProcessor(model_file=path)
        counts = [len(model.encode(t or "")) for _, t in rows]
    else:
        model = Tokenizer.from_file(path)
        counts = [len(model.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return sorted((str(k), len((t or "").encode()), n, n > 4096) for (k, t), n in zip(rows, counts, strict=True))


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_counts_are_the_librarys(spark, odd, documents, path):
    for docs in (odd, documents):
        cache = new_folder(spark, "cache")
        found = token_counts.token_counts(docs, cache, path).collect()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == _expected(rows, path)


def test_only_what_the_cache_lacks_is_encoded(spark, documents):
    cache = new_folder(spark, "cache")
    half = documents.where("doc_id % 2 = 0")
    sizes = []
    for docs in (half, half, documents, documents):
        token_counts.token_counts(docs, cache, PIECES).collect()
        sizes.append(spark.read.parquet(cache).count())
    distinct = [d.select("text").distinct().count() for d in (half, documents)]
    assert sizes == [distinct[0], distinct[0], distinct[1], distinct[1]]
    # Another tokenizer has counts of its own.
    assert token_counts.read_cache(spark, cache, token_counts.tokenizer_digest(BYTES)).count() == 0
    # What two jobs stored at once counts once.
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert token_counts.token_counts(documents, cache, PIECES).count() == documents.count()


def test_empty(spark, empty):
    assert token_counts.token_counts(empty, new_folder(spark, "cache"), PIECES).collect() == []
