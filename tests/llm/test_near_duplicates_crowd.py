"""Pairs above the limit inside a crowd of texts just below it."""

import random

from personyear.llm.near_duplicates import near_duplicates
from tests.llm import brute
from tests.llm.conftest import SCHEMA, words_of


def _similarity(one, two):
    one, two = brute.shingles(one), brute.shingles(two)
    return len(one & two) / len(one | two)


def test_planted_pairs_in_a_crowd_match_all_pairs(spark):
    rng = random.Random(31)
    template = words_of(rng, 160)
    rows = []
    for k in range(400):
        rows.append((k, " ".join(template + words_of(rng, 34))))
    for k in range(400, 500, 2):
        shared = words_of(rng, 8)
        for copy in range(2):
            rows.append((k + copy, " ".join(template + shared + words_of(rng, 26))))
    assert 0.69 < _similarity(rows[0][1], rows[1][1]) < 0.71
    assert 0.75 < _similarity(rows[400][1], rows[401][1]) < 0.77
    rng.shuffle(rows)
    expected = brute.groups_of(rows)
    assert len(set(expected.values())) == 450
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == expected
