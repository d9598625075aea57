import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from personyear.llm import spelling

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    words = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def edits(word, letters):
    """All texts at an edit distance of one, by its definition."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cut if b}
    found |= {a + c + b[1:] for a, b in cut if b for c in letters}
    found |= {a + c + b for a, b in cut for c in letters}
    return found - {word}


def plain(rows):
    words = plain_counts(rows)
    letters = {c for w in words for c in w}
    near = {w: [v for v in edits(w, letters) if v in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    found = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        found.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(found)


def own(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in spelling.variants(docs, **options).collect())


@pytest.fixture(scope="module")
def misspelt():
    """Words and their variants, many of one letter vector, with chains of forms."""
    rng = random.Random(3)
    rows, words = [], ["".join(rng.choices("abcdé", k=rng.randint(7, 9))) for _ in range(60)]
    for i in range(400):
        text = []
        for _ in range(40):
            word = words[min(int(rng.expovariate(0.15)), 59)]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(("", rng.choice("abcdéÿ"), word[at] + rng.choice("abz"))) + word[at + 1 :]
            text.append(word if rng.random() < 0.9 else word.upper())
        rows.append((i, rng.choice((" ", ", ", "7", "\n")).join(text)))
    return rows


def test_misspelt_words(spark, misspelt):
    found = own(spark, misspelt)
    assert found == plain(misspelt)
    assert any(r[1] is not None and r[1] != r[2] for r in found)


@pytest.mark.parametrize("options", [{"cell_words": 5}, {"cell_words": 8, "cell_questions": 40}])
def test_deep_tries_and_cells(spark, misspelt, options):
    assert own(spark, misspelt[:60], **options) == plain(misspelt[:60])


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert own(spark, rows) == plain(rows)


def test_odd_rows(spark, odd_rows):
    rows = [r[:2] for r in odd_rows]
    assert own(spark, rows) == plain(rows)


def test_long_runs_ties_repeats_and_capped_counts(spark):
    base = "abcdefgh" * 12
    long = [base, base + "x", base[:50] + "y" + base[50:], base[:70] + "z" + base[71:], "a" * 40, "a" * 41, "a" * 39 + "b", "a" * 40 + "b", "b" + "a" * 39]
    rows = [(k, " ".join([w, w, w])) for k, w in enumerate(long)]
    rows += [(k, "samelen samelem samelef " * (k % 3 + 1)) for k in range(50, 60)] + [(50, "samelen " * 40), (None, "samelen " * 3), (None, None), (7, "")]
    assert own(spark, rows) == plain(rows)


def test_empty_and_other_columns(spark, empty):
    assert spelling.variants(empty).collect() == []
    docs = spark.createDataFrame([(1, "lettering lettering", 1, "x")], "doc_id long, text string, n int, word string")
    assert [tuple(r) for r in spelling.variants(docs).collect()] == [("lettering", None, "lettering", 2, 0, None)]


def test_every_near_word_is_asked_where_it_is_filed():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (300, spelling.GROUPS))
    keys = np.concatenate([spelling.prefix_keys(counts, d) for d in range(spelling.GROUPS)])
    found, n = np.unique(keys, return_counts=True)
    heavy = found[n > 6]
    filed = spelling.filed_under(counts, heavy)
    row, asked = spelling.asked_under(counts, heavy)
    places = set(zip(row.tolist(), asked.tolist(), strict=True))
    for i, one in enumerate(counts):
        gap = counts - one
        near = (np.maximum(gap, 0).sum(axis=1) <= 1) & (np.maximum(-gap, 0).sum(axis=1) <= 1)
        assert all((i, int(filed[j])) in places for j in np.flatnonzero(near))
