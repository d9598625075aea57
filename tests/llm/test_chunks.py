import random

from personyear.llm.chunks import _gear, repeated_passages
from tests.llm import brute
from tests.llm.conftest import SCHEMA, words_of

GEAR = [int(x) for x in _gear()]


def _frame(spark, rows):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)


def _found(df):
    return [(r.doc_id, r.deduplicated, r.n_words, r.n_removed) for r in repeated_passages(df).collect()]


def test_given_documents_match_the_plain_version(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(_found(documents)) == sorted(brute.together(rows, GEAR))


def test_planted_passages_are_cut_from_later_documents_only(spark):
    rng = random.Random(11)
    rows, planted = [], {}
    for number in range(60):
        passage = words_of(rng, 51 + number)
        for copy in range(3):
            key = 1000 + 3 * number + copy
            before, after = words_of(rng, rng.randint(0, 40)), words_of(rng, rng.randint(0, 40))
            rows.append((key, " ".join(before + passage + after)))
            planted[key] = (copy, len(passage))
    clean = [(k, " ".join(words_of(rng, 80))) for k in range(50)]
    short = " ".join(words_of(rng, 12))
    clean += [(100 + k, short + "\n" + " ".join(words_of(rng, 30))) for k in range(20)]
    everything = rows + clean
    rng.shuffle(everything)
    found = {k: (t, removed) for k, t, _, removed in _found(_frame(spark, everything))}
    texts = dict(everything)
    missed = 0
    for key, (copy, size) in planted.items():
        text, removed = found[key]
        if copy == 0:
            assert (text, removed) == (texts[key], 0)
        else:
            assert removed <= size
            missed += removed < 20
    assert missed <= 1
    assert all(found[k] == (t, 0) for k, t in clean)


def test_many_tasks_agree_with_one(spark):
    rng = random.Random(12)
    passages = [" ".join(words_of(rng, 70)) for _ in range(4)]
    rows = [(k, " ".join([*words_of(rng, 15), rng.choice(passages), *words_of(rng, 15), rng.choice(passages)])) for k in range(120)]
    expected = sorted(brute.together(rows, GEAR))
    assert sorted(_found(_frame(spark, rows).repartition(9))) == expected
    assert sorted(_found(_frame(spark, rows).coalesce(1))) == expected


def test_odd_rows(odd, empty):
    found = {(r.doc_id, r.text): r for r in repeated_passages(odd).collect()}
    assert repeated_passages(odd).count() == odd.count()
    assert found[1, None].deduplicated is None and found[2, ""].deduplicated == ""
    long_copy = next(r for (k, _), r in found.items() if k == 8)
    assert long_copy.n_removed > 59_900
    assert all(r.deduplicated == r.text for (k, _), r in found.items() if k != 8)
    assert repeated_passages(empty).collect() == []


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, n_words int, spans string")
    row = repeated_passages(df).first()
    assert (row.n_words, row.spans, row.deduplicated) == (2, [], "a b")
