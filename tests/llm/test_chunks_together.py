"""Repeats are cut only where all their chunks stand together in one earlier place."""

import random

import numpy as np

from personyear.llm.chunks import _gear, _smallest, repeated_passages
from tests.llm import brute
from tests.llm.conftest import SCHEMA, words_of

GEAR = [int(x) for x in _gear()]
LEAST = 20


def _expected(rows):
    """(id, text, words, words cut): all equal runs of chunks of every two places, tried one by one."""
    texts = []
    for key, text in sorted(rows):
        words, bounds = brute.chunk_bounds(text, GEAR, 16, 4)
        data = text.encode()
        ends = [b[0] for b in bounds[1:]] + [len(words)]
        texts.append((key, data, words, [data[a:z] for _, a, z in bounds], [b[0] for b in bounds], ends))
    result = []
    for n, (key, data, words, chunks, first, ends) in enumerate(texts):
        gone = set()
        for m in range(n + 1):
            earlier = texts[m][3]
            for i in range(len(chunks)):
                for j in range(i if m == n else len(earlier)):
                    k = 0
                    while i + k < len(chunks) and j + k < len(earlier) and chunks[i + k] == earlier[j + k]:
                        k += 1
                    if k and ends[i + k - 1] - first[i] >= LEAST:
                        gone.update(range(first[i], ends[i + k - 1]))
        kept, at = b"", 0
        for w in sorted(gone):
            kept += data[at : words[w][0]] if at < words[w][0] else b""
            at = words[w + 1][0] if w + 1 < len(words) else len(data)
        result.append((key, (kept + data[at:]).decode(), len(words), len(gone)))
    return result


def _found(spark, rows, tasks=3):
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA).repartition(tasks)
    return sorted((r.doc_id, r.deduplicated, r.n_words, r.n_removed) for r in repeated_passages(df).collect())


def test_common_chunks_from_many_places_are_no_repeat(spark):
    """Clean texts of a small vocabulary, whose chunks nearly all occur before, somewhere."""
    rng = random.Random(21)
    vocabulary = words_of(rng, 5)
    rows = [(k, " ".join(rng.choices(vocabulary, k=70))) for k in range(600)]
    assert sum(r[3] for r in brute.repeated(rows, GEAR)) > 1000
    assert all(removed == 0 and text == dict(rows)[k] for k, text, _, removed in _found(spark, rows))


def test_repeats_in_a_small_vocabulary_match_all_pairs(spark):
    rng = random.Random(22)
    vocabulary = words_of(rng, 12)
    passages = [rng.choices(vocabulary, k=n) for n in (19, 20, 30, 45, 60)]
    rows = []
    for k in range(60):
        own = [rng.choices(vocabulary, k=rng.randint(0, 25)) for _ in range(3)]
        rows.append((k, " ".join([*own[0], *rng.choice(passages), *own[1], *rng.choice(passages), *own[2]])))
    rows.append((60, " ".join([vocabulary[0], vocabulary[1], vocabulary[2]] * 40)))
    expected = _expected(rows)
    assert 0 < sum(r[3] for r in expected) < sum(r[3] for r in brute.repeated(rows, GEAR))
    assert _found(spark, rows) == expected
    assert _found(spark, rows, 1) == expected


def test_periodic_passages_are_found(spark):
    """Passages of a few words over and over, in two documents each with text of its own around."""
    rng = random.Random(23)
    rows, sizes = [], {}
    for period in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12):
        for number in range(40):
            size = 60 + rng.randint(0, 20)
            passage = (words_of(rng, period) * size)[:size]
            for copy in range(2):
                key = 10_000 * copy + 100 * period + number
                rows.append((key, " ".join([*words_of(rng, rng.randint(5, 40)), *passage, *words_of(rng, rng.randint(5, 40))])))
            sizes[key] = (period, size)
    found = _found(spark, rows)
    assert found == sorted(brute.together(rows, GEAR))
    removed = {k: n for k, _, _, n in found}
    for period in sorted({p for p, _ in sizes.values()}):
        caught = [removed[k] >= 20 for k, (p, _) in sizes.items() if p == period]
        assert sum(caught) >= 0.9 * len(caught), (period, sum(caught))
    # What stands around them stays.
    assert all(removed[k] <= size for k, (_, size) in sizes.items())


def test_smallest_of_the_words_before():
    values = np.array([5, 3, 9, 9, 9, 1, 7], dtype=np.uint32)
    for count in range(1, 9):
        assert list(_smallest(values, count)) == [min(values[max(0, i - count + 1) : i + 1]) for i in range(len(values))]
