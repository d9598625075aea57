import corpus_pipeline
import numpy as np
import pytest

from personyear.llm import buckets, decontaminate, toxicity
from personyear.llm.chunks import _gear
from tests.llm import brute
from tests.llm.conftest import SCHEMA

FOLDER = "/root/testdata/sf0.01"


def _letters_out(text, items):
    """The text without the words of occurring windows and what stands between neighbouring ones."""
    text_bytes = (text or "").translate(brute.SMALL).encode()
    import re

    places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text_bytes)]
    windows = {}
    for item in items:
        words = brute.letters(item)
        size = min(len(words), decontaminate.WINDOW)
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(size, set()).add(tuple(words[i : i + size]))
    words, hit = brute.letters(text), set()
    for size, own in windows.items():
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in own:
                hit.update(range(i, i + size))
    data, parts, at, i = (text or "").encode(), [], 0, 0
    while i < len(words):
        j = i
        while j < len(words) and j in hit:
            j += 1
        if j > i:
            parts.append(data[at : places[i][0]])
            at = places[j - 1][1]
        i = max(j, i + 1)
    parts.append(data[at:])
    return None if text is None else b"".join(parts).decode(), len(words), len(hit)


def test_stages_match_plain_versions(spark):
    """Each stage against a plain version on its own input."""
    docs = documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "minhash near-dedup", "substring dedup", "benchmark decontamination", "packing",
    ]

    def rows(df):
        assert df.columns == documents.columns
        return sorted(map(tuple, df.collect()))

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.toxicity(docs, labels).collect()
    left = sorted(tuple(r)[:5] for r in scored if r.score < toxicity.CUT)
    assert rows(stages["toxicity"](spark, docs, FOLDER)) == left and 0 < len(left) < len(scored)

    docs = spark.createDataFrame(left, SCHEMA)
    groups = brute.groups_of([r[:2] for r in left])
    left = [r for r in left if groups[r[0]] == r[0]]
    assert rows(stages["minhash near-dedup"](spark, docs, FOLDER)) == left and len(left) < docs.count()

    docs = spark.createDataFrame(left, SCHEMA)
    cut = {k: (t, n, gone) for k, t, n, gone in brute.together([r[:2] for r in left], [int(x) for x in _gear()])}
    left = [(k, cut[k][0], lang, source, len(cut[k][0])) for k, _, lang, source, _ in left if not cut[k][2] or cut[k][2] < cut[k][1]]
    assert rows(stages["substring dedup"](spark, docs, FOLDER)) == left

    docs = spark.createDataFrame(left, SCHEMA)
    cleaned = {r[0]: _letters_out(r[1], items) for r in left}
    left = [(k, cleaned[k][0], lang, source, len(cleaned[k][0])) for k, _, lang, source, _ in left if not cleaned[k][1] or cleaned[k][2] < cleaned[k][1]]
    assert any(c[2] for c in cleaned.values())
    assert rows(stages["benchmark decontamination"](spark, docs, FOLDER)) == left

    docs = spark.createDataFrame(left, SCHEMA)
    packed = stages["packing"](spark, docs, FOLDER).collect()
    lengths = [min(4096, len(r[1].encode()) + 1 - a) for r in left for a in range(0, len(r[1].encode()) + 1, 4096)]
    assert sorted(r.length for r in packed) == sorted(lengths)
    values, counts = np.unique(lengths, return_counts=True)
    bounds = buckets.boundaries(values, counts, buckets.BUCKETS)
    assert sorted(r.bucket_length for r in packed) == sorted(min(b for b in bounds if b >= n) for n in lengths)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, odd, empty, name, stage):
    found = stage(spark, odd, FOLDER)
    if name != "packing":
        assert found.columns == odd.columns
        kept = {(r.doc_id, r.text) for r in found.collect()}
        assert {(1, None), (2, ""), (4, "one"), (None, None)} <= kept
    assert stage(spark, empty, FOLDER).collect() == []
