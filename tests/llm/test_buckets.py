import itertools
import random

import numpy as np

from personyear.llm import buckets


def _padded(lengths, counts, bounds):
    return sum(n * min(b for b in bounds if b >= x) for x, n in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 4):
            found = buckets.boundaries(np.array(lengths), np.array(counts), k)
            choices = itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1)
            best = min(_padded(lengths, counts, (*c, lengths[-1])) for c in choices)
            assert _padded(lengths, counts, found) == best and len(found) == min(k, len(lengths))


def _checked(spark, rows, context, k, budget):
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = buckets.pack(df, context=context, buckets=k, budget=budget, slice_rows=7).collect()
    expected = []
    for key, text, _ in rows:
        n = len((text or "").encode()) + 1
        expected += [(str(key), i, a, min(context, n - a)) for i, a in enumerate(range(0, n, context))]
    assert sorted((str(r.doc_id), r.segment, r.start, r.length) for r in found) == sorted(expected)
    bounds = sorted({r.bucket_length for r in found})
    lengths, counts = np.unique([e[3] for e in expected], return_counts=True)
    assert sum(r.bucket_length for r in found) == _padded(lengths, counts, buckets.boundaries(lengths, counts, k))
    for bound in bounds:
        own = [r for r in found if r.bucket_length == bound]
        size = max(1, budget // bound)
        assert sorted(r.batch * size + r.slot for r in own) == list(range(len(own)))
        assert all(r.slot < size and r.padding == bound - r.length >= 0 for r in own)
        assert all(r.length > max([b for b in bounds if b < bound], default=0) for r in own)


def test_every_byte_is_in_one_slot(spark):
    rng = random.Random(2)
    rows = [(k, "é" * rng.randint(0, 40), 3) for k in range(200)] + [(5, "same", 1)] * 30 + [(None, None, None), (7, "", 0), (8, "x" * 999, 0)]
    _checked(spark, rows, 32, 4, 100)
    _checked(spark, rows, 4096, 8, 1)


def test_odd_rows(odd, empty):
    assert buckets.pack(empty).collect() == []
    found = buckets.pack(odd.withColumnRenamed("lang", "batch"))
    assert found.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
