import random
import zlib

import numpy as np
import pyarrow as pa

from personyear.llm import hashing, toxicity
from tests.llm import brute
from tests.llm.conftest import words_of


def _labelled(spark, folder):
    return (spark.read.parquet(f"/root/testdata/{folder}/{name}.parquet") for name in ("documents", "labels"))


def _learnt(docs, labels):
    names = docs.selectExpr("doc_id as id", "text")
    known = labels.where(~toxicity.held_out(labels.doc_id)).selectExpr("doc_id as id", "toxic as label")
    return toxicity.fit(names, known)


def test_neighbours_are_exact(spark):
    """Block bounds skip nothing: the same neighbours and cosines as from all examples."""
    index = _learnt(*_labelled(spark, "sf0.1"))
    size = len(index.ids)
    dense = np.zeros((size, index.vocabulary.size))
    for word in range(index.vocabulary.size):
        some = slice(index.post_from[word, 0], index.post_from[word, -1])
        dense[index.post_example[some], word] = index.post_weight[some]
    assert size > 3 * toxicity.BLOCK and np.allclose((dense**2).sum(axis=1), 1)
    rng = np.random.default_rng(0)
    for _ in range(300):
        words = np.sort(rng.choice(index.vocabulary.size, rng.integers(1, min(7, index.vocabulary.size + 1)), replace=False))
        counts = rng.integers(1, 5, len(words))
        found, cosines = index.neighbours(words, counts, 25)
        weight = (1 + np.log(counts)) * index.idf[words]
        every = np.round(dense[:, words] @ (weight / np.sqrt((weight**2).sum())), 9)
        order = [i for i in np.lexsort((np.arange(size), -every)) if every[i] > 0][:25]
        assert np.allclose(cosines, every[order], atol=2e-9)
        assert np.allclose(np.sort(every[found]), np.sort(every[order]), atol=2e-9) and len(set(found)) == len(order)


def test_held_out_documents_are_told_apart(spark):
    docs, labels = _labelled(spark, "sf0.1")
    scored = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id")
    rows = scored.where(toxicity.held_out(scored.doc_id)).select("doc_id", "text", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    toxic, clean = ([r for r in rows if r.toxic == x] for x in (1, 0))
    assert len(toxic) > 80 and len(clean) > 600
    # Some toxic texts of these tables are one word over and over.
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # Calibrated: the mean score is near the share of toxic labels.
    assert abs(sum(r.score for r in rows) / len(rows) - len(toxic) / len(rows)) < 0.02


def test_held_out_labels_change_nothing(spark):
    docs, labels = _labelled(spark, "sf0.01")
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    one, two = (sorted(map(tuple, toxicity.toxicity(docs, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert one == two


def test_term_counts_are_words_and_their_beginnings():
    texts = ["Bad bad good", None, "", "good, bad. Worse! ärger ärgerlich", "wors worst"]
    terms = ["bad", "worse", "wors*", "ärge*", "ärger*"]

    def count(text, term):
        words = brute.letters(text)
        return sum(w.startswith(term[:-1]) for w in words) if term.endswith("*") else words.count(term)

    keys = {}
    with np.errstate(over="ignore"):
        for term in terms:
            piece = next(hashing.pieces(pa.array([term.rstrip("*")]), hashing.LETTERS, True, hashing.Powers()))
            keys[term] = (piece.beginnings(len(term) - 1)[1] if term.endswith("*") else piece.hashes())[0]
        ordered = np.sort(np.array(list(keys.values()), dtype=np.uint64))
        found = list(toxicity._term_counts(pa.array(texts), ordered, hashing.Powers()))
    assert len(found) == 1
    _, rows, row, place, counts = found[0]
    got = {(int(r), int(p)): int(c) for r, p, c in zip(row, place, counts, strict=True)}
    assert rows == 5
    expected = {(r, int(np.searchsorted(ordered, keys[t]))): count(x, t) for r, x in enumerate(texts) for t in terms}
    assert got == {k: n for k, n in expected.items() if n}


def test_odd_rows_and_missing_labels(spark, odd, empty):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.5}
    one_class = spark.createDataFrame([(i, 0, 0) for i in range(12)], schema)
    assert {(r.predicted, len(r.evidence)) for r in toxicity.toxicity(odd, one_class).collect()} == {(0, 0)}
    strange = spark.createDataFrame([(None, 0, 1), (4, 0, None), (4, 0, 7), (5, 1, 1), (5, 1, 0), (99, 0, 0)], schema)
    assert toxicity.toxicity(odd, strange).count() == odd.count()
    assert toxicity.toxicity(empty, one_class).collect() == []


def test_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(k, ("vile " if k % 3 == 0 else "") + " ".join(words_of(rng, 30)), 9.0, "x") for k in range(300)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, score double, evidence string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels)
    assert found.columns == ["doc_id", "text", "score", "predicted", "evidence"]
    assert {(r.doc_id % 3 == 0, r.predicted) for r in found.collect()} == {(True, 1), (False, 0)}
    assert found.count() == 340
