import public_tokenizers
import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from personyear.llm import pieces, queries

FOLDER = "/root/testdata/sf0.001"

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [
    "", " ", "  ", "   ", "a", " a", "a ", "a  ", "  a  b ", "▁", "a▁b", "▁▁ a", "a" + " " * 40 + "b",
    "\x00", "a\x00 b", "\t\n a", "<s> </s> <unk>", "<0x41>", "\U0001f600 Ⅶ", "x", "x x", "​ ﻿", "é é",
]


def _library(rows, ends=True):
    model = SentencePieceProcessor(model_file=PATH)
    found = []
    for key, text in rows:
        ids = model.encode(text or "", add_bos=ends, add_eos=ends)
        found.append((str(key), ids, model.decode(ids)))
    return sorted(found)


def _own(docs, **options):
    rows = pieces.decode(pieces.encode(docs, PATH, **options), PATH).collect()
    return sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist(), r.text) for r in rows)


@pytest.mark.parametrize(("characters", "words"), [(1, 1), (40, 10), (1 << 20, 400_000)])
def test_edges_in_tables_of_any_size(spark, characters, words, monkeypatch):
    monkeypatch.setattr(pieces, "CALL_CHARACTERS", characters)
    monkeypatch.setattr(pieces, "TABLE_WORDS", words)
    rows = list(enumerate([*EDGES, None]))
    assert _own(spark.createDataFrame(rows, "doc_id long, text string")) == _library(rows)


def test_odd_rows_and_given_documents(spark, odd, documents):
    for docs in (odd, documents):
        assert _own(docs) == _library([(r.doc_id, r.text) for r in docs.collect()])


def test_without_ends(spark):
    rows = [(1, "one two"), (2, None)]
    assert _own(spark.createDataFrame(rows, "doc_id long, text string"), ends=False) == _library(rows, ends=False)


def test_slices_of_long_texts(spark, documents, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 50)
    monkeypatch.setattr(pieces, "TOGETHER", 7)
    rows = [(1, "   a  b" * 300), (2, "b" * 5000), (3, " " * 500), *[(r.doc_id, r.text) for r in documents.limit(40).collect()]]
    assert _own(spark.createDataFrame(rows, "doc_id long, text string")) == _library(rows)


def test_other_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, "w")], "doc_id long, text string, ids string, block int, words string")
    assert _own(docs) == _library([(1, "a b")])


def test_empty(spark, empty):
    assert _own(empty) == []


def test_each_distinct_word_is_segmented_once():
    class Counting:
        def __init__(self):
            self.model, self.asked = SentencePieceProcessor(model_file=PATH), []

        def encode(self, texts, **options):
            self.asked += texts
            return self.model.encode(texts, **options)

    table = pieces.Table(Counting())
    for text in ("one two  one", "two three", "three one"):
        words = pieces._numbered(text, table.numbers)
        table.learn()
        assert np.frombuffer(table.joined(words), dtype="<u4").tolist() == table.model.model.encode(text)
    assert sorted(table.model.asked) == ["x  one", "x one", "x three", "x two"]


def test_models_that_do_not_fall_apart_are_refused(monkeypatch):
    class Crossing:
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "of▁the")

    monkeypatch.setattr(pieces, "_library", lambda path: Crossing())
    with pytest.raises(ValueError, match="cross"):
        pieces.check_model(PATH)


def test_query(spark):
    import hashlib

    rows = {r.doc_id: r for r in queries.op12_pieces(spark, FOLDER).collect()}
    model = SentencePieceProcessor(model_file=PATH)
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for doc in texts:
        ids = model.encode(doc.text or "", add_bos=True, add_eos=True)
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
