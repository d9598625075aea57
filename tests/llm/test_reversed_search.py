import math
import re
from collections import Counter

import pytest

from personyear.llm import reversed_search

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=20):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    counted = [(key, c, sum(c.values())) for key, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, Counter()).update(terms(text))
    found = []
    for item, query in wanted.items():
        scored = []
        for key, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = 0
            for t, times in query.items():
                if t in c:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * weight * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        scored.sort(key=lambda x: x[:3])
        found += [(str(item), rank, str(key), -s) for rank, (s, _, _, key) in enumerate(scored[:k], 1)]
    return sorted(found)


def own(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = reversed_search.search(docs, items, **options).collect()
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in rows)


@pytest.fixture(scope="module")
def given(spark):
    read = lambda name: [tuple(r)[:2] for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()]
    return read("documents"), read("benchmark")


def test_given_tables(spark, given):
    assert own(spark, *given) == plain(*given)


@pytest.mark.parametrize("options", [{"block_items": 2}, {"block_postings": 30}, {"k": 1}])
def test_blocks_and_other_k(spark, given, options):
    docs, items = given
    assert own(spark, docs, items[:7], **options) == plain(docs, items[:7], options.get("k", 20))


def test_large_sums_stay_whole_numbers(spark, given, monkeypatch):
    monkeypatch.setattr(reversed_search, "EXACT", 1)
    docs, items = given
    assert own(spark, docs, items[:5]) == plain(docs, items[:5])


def test_small_buffers(spark, given, monkeypatch):
    monkeypatch.setattr(reversed_search, "CELLS", 3)
    docs, items = given
    assert own(spark, docs, items[:5], k=2) == plain(docs, items[:5], 2)


def test_odd_rows_ties_and_repeats(spark, odd_rows):
    docs = [r[:2] for r in odd_rows] + [(k, "equal words") for k in range(100, 140)] + [(100, "equal words")]
    items = [(1, "the same EQUAL equal words"), (1, "one"), (2, None), (3, ""), (None, "for text"), (4, "nowhere-zz"), (5, "Ⅻ ½ 日本語 İstanbul")]
    assert own(spark, docs, items) == plain(docs, items)


def test_a_term_of_all_documents_may_weigh_nothing(spark):
    docs = [(k, "a") for k in range(3000)]
    assert own(spark, docs, [(1, "a")]) == plain(docs, [(1, "a")]) == []


def test_empty_tables_and_other_columns(spark):
    assert own(spark, [], [(1, "a")]) == [] and own(spark, [(1, "a")], []) == []
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, score int, item int")
    items = spark.createDataFrame([(1, "a", 5)], "item_id long, text string, rank int")
    assert reversed_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
