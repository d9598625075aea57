import hashlib
import random

import numpy as np

from personyear.llm import decontaminate
from tests.llm import brute
from tests.llm.conftest import SCHEMA


def _found(docs, items, **options):
    rows = decontaminate.contamination(docs, items, **options).collect()
    for r in rows:
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, r.items))).encode()).hexdigest()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in rows)


def _expected(docs, items):
    found = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    return sorted((str(k), n, hit, owners) for k, n, hit, owners in found)


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 5, 300):
        text = np.concatenate((rng.integers(1, alphabet + 1, 200), [0]))
        order = decontaminate.suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        tree = decontaminate.WaveletMatrix(text, int(alphabet).bit_length())
        places = rng.integers(0, len(text) + 1, 50)
        symbols = rng.integers(0, alphabet + 1, 50)
        assert tree.rank(symbols, places).tolist() == [int((text[:p] == s).sum()) for s, p in zip(symbols, places, strict=True)]
        every = np.arange(len(text))
        got, before = tree.access(every)
        assert got.tolist() == text.tolist()
        assert before.tolist() == [int((text[:i] == text[i]).sum()) for i in every]


def test_few_words_many_overlaps_over_shards_and_blocks(spark):
    rng = random.Random(2)
    letters = ["a", "b", "C", "dd", "é"]
    docs = [(k, rng.choice([" ", ", "]).join(rng.choices(letters, k=rng.randint(0, 120))), None, None, None) for k in range(80)]
    items = [(k, " ".join(rng.choices(letters, k=rng.choice([0, 1, 3, 4, 10, 11, 25])))) for k in range(30)]
    items += [(None, "a b c dd é a b c"), (77, None), (3, "dd dd dd dd dd dd")]
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    expected = _expected(docs, items)
    assert _found(docs.repartition(3), items) == expected
    assert _found(docs, items, shard_words=200, block_bytes=60) == expected


def test_given_documents(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert _found(documents, items) == _expected(documents, items)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "text for two"), (2, "日本語"), (3, "")], "item_id long, text string")
    assert _found(odd, items) == _expected(odd, items)
    assert _found(empty, items) == []
    nothing = items.where("item_id > 9")
    assert {r[2] for r in _found(odd, nothing)} == {0}


def test_spans_are_cut(spark):
    docs = spark.createDataFrame(
        [(1, "Ä start. One TWO three, und weiter"), (2, "one two three"), (3, None), (4, "clean")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = decontaminate.contamination(docs.withColumn("n_hit", docs.doc_id), items)
    left = decontaminate.without_spans(found)
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(tuple, left.collect())) == [(1, "Ä start. , und weiter"), (3, None), (4, "clean")]
