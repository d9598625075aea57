import random

import numpy as np
import pyarrow as pa

from personyear.llm import hashing
from personyear.llm.components import components
from personyear.llm.near_duplicates import near_duplicates
from tests.llm import brute
from tests.llm.conftest import SCHEMA, words_of


def test_words_are_those_of_the_pattern(odd_rows):
    texts = [r[1] for r in odd_rows] + ["", "a" * 3_000_000, "x y"]
    with np.errstate(over="ignore"):
        for table, pattern in ((hashing.LETTERS, brute.LETTERS), (hashing.NOT_BLANK, brute.NOT_BLANK)):
            found, hashes = [[] for _ in texts], {}
            for piece in hashing.pieces(pa.array(texts), table, True, hashing.Powers()):
                for row, a, z, h in zip(piece.row, piece.starts, piece.ends, piece.hashes(), strict=True):
                    word = piece.data[a:z].tobytes()
                    found[piece.first + row].append(word.decode())
                    assert hashes.setdefault(word, h) == h
            assert found == [pattern.findall((t or "").translate(brute.SMALL)) for t in texts]
            assert len(set(hashes.values())) == len(hashes)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 400), 100), **dict.fromkeys(range(500, 503), 500)}


def _checked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = near_duplicates(df).collect()
    groups = brute.groups_of([(r[0], r[1]) for r in rows])
    expected = sorted((str(r[0]), len(brute.shingles(r[1])), groups.get(r[0]), r[0] is None or groups[r[0]] == r[0]) for r in rows)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in found) == expected
    return found


def test_given_documents_match_all_pairs(spark, documents):
    _checked(spark, [tuple(r) for r in documents.select("doc_id", "text", "lang", "source", "n_chars").collect()])


def test_links_near_the_limit_and_shared_passages(spark):
    """Copies edited to similarities around 0.75, a large group of near copies, and a passage that many texts share."""
    rng = random.Random(3)
    rows, key = [], 0
    passage = words_of(rng, 60)
    for edits in range(1, 9):
        for _ in range(6):
            base = words_of(rng, 150)
            copy = list(base)
            for at in rng.sample(range(5, 145), edits):
                copy[at] = "changed" + str(at)
            for words in (base, copy):
                rows.append((key, " ".join(words), None, None, None))
                key += 1
    base = words_of(rng, 120)
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = "other" + str(rng.random())
        rows.append((key, " ".join(copy), None, None, None))
        key += 1
    for _ in range(150):
        rows.append((key, " ".join(words_of(rng, 40) + passage + words_of(rng, 30)), None, None, None))
        key += 1
    rng.shuffle(rows)
    _checked(spark, rows)


def test_odd_rows(spark, odd_rows, empty):
    found = _checked(spark, odd_rows)
    assert {r.component_id for r in found if r.doc_id in (10, 11)} == {10}
    assert near_duplicates(empty).collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(4)
    one, two, three = (" ".join(words_of(rng, 40)) for _ in range(3))
    rows = [(5, one), (5, two), (3, two), (9, three), (5, three), (1, "alone")]
    found = near_duplicates(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (3, 3), (5, 3), (5, 3), (5, 3), (9, 3)]
