import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from personyear.llm import token_files
from tests.llm.conftest import SCHEMA

PATH = public_tokenizers.path("word_bpe_49k.json")


def _expected(rows):
    model = Tokenizer.from_file(PATH)
    start, found = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        found.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return found


def _found(docs):
    rows = token_files.round_trip(docs, PATH).collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_given_documents(documents):
    assert _found(documents) == _expected([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd, odd_rows, empty):
    assert _found(empty) == []
    found, expected = _found(odd), _expected([r[:2] for r in odd_rows])
    # Rows without id come first, in the order of their records.
    assert sorted(r[2:] for r in found[:2]) == sorted(r[2:] for r in expected[:2])
    assert found[2:] == expected[2:]


def test_any_text(spark):
    texts = ["A.B", "o'clock 's 'S it's.", "x.,;y", "ﬀ ŉ ǅ ß ẞ İ ı", "á é", "क़ क़", "٣ 3 ³", "\x85\xa0 z", "...", "a...b", "Ä.Ö!"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    assert _found(spark.createDataFrame(rows, SCHEMA)) == _expected([r[:2] for r in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), max_size=8))
def test_words_are_encoded_as_whole_texts_are(texts):
    import pyarrow as pa

    from personyear.llm import hashing

    encoder, model = _encoder(), Tokenizer.from_file(PATH) if not hasattr(_encoder, "model") else _encoder.model
    _encoder.model = model
    with np.errstate(over="ignore"):
        for piece in hashing.pieces(pa.array(texts, pa.string()), hashing.NOT_BLANK, False, hashing.Powers()):
            ids, counts = encoder.encode(piece)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for text, part in zip(texts, parts, strict=True):
                assert part.tolist() == model.encode(text, add_special_tokens=False).ids


def _encoder():
    if not hasattr(_encoder, "own"):
        _encoder.own = token_files.WordEncoder(PATH)
    return _encoder.own


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=12), max_size=9))
def test_numbers_come_back(records):
    counts = np.array([len(r) for r in records], dtype=np.int64)
    values = np.array([x for r in records for x in r], dtype=np.uint32)
    control, data = token_files.pack_numbers(values, counts)
    assert [len(c) for c in control] == [-(-n // 4) for n in counts]
    assert token_files.unpack_numbers(control, data, counts).tolist() == values.tolist()


def test_frequent_ids_take_one_byte(spark, documents):
    from personyear.session import new_folder

    path = new_folder(spark, "tokens")
    token_files.write_tokens(documents, path, PATH)
    ranking = spark.read.parquet(f"{path}/ranking").orderBy("rank").collect()
    assert [r.n for r in ranking] == sorted((r.n for r in ranking), reverse=True)
    total = sum(r.n for r in ranking)
    size = spark.read.parquet(f"{path}/records").selectExpr("sum(length(data)) as n").first().n
    assert size == sum(r.n * (1 + (r["rank"] > 255)) for r in ranking) < 2 * total


def test_the_later_tasks_of_a_worker_know_its_units(spark, documents):
    """More tasks than workers: a task with the same texts as an earlier one of its worker learns nothing."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from personyear.llm import hashing

    kept = spark.sparkContext.broadcast({})
    text = "the same few words, in every task of it. naïve x2"

    def run(batches):
        rows = sum(batch.num_rows for batch in batches)
        encoder = token_files._worker_encoder(kept.value, PATH)
        before = encoder.count
        with np.errstate(over="ignore"):
            for piece in hashing.pieces(pa.array([text]), hashing.NOT_BLANK, False, hashing.Powers()):
                ids, _ = encoder.encode(piece)
        yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([rows])], ["before", "ids", "rows"])

    found = spark.range(64, numPartitions=64).select(F.col("id")).mapInArrow(run, "before long, ids array<long>, rows long").collect()
    assert len(found) == 64
    assert sum(r.before == 1 for r in found) < 64
    expected = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert all(r.ids == expected for r in found)


def test_distinct_values_are_those_of_numpy():
    values = np.array([5, 2**64 - 1, 5, 0, 7, 0], dtype=np.uint64)
    found, at, number = token_files._distinct(values)
    assert found.tolist() == sorted(set(values.tolist()))
    assert (values[at] == found).all() and (found[number] == values).all()
    assert [len(x) for x in token_files._distinct(values[:0])] == [0, 0, 0]
