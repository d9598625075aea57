import random

import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, count, letters="abcdefghijklmnop", low=2, high=9):
    return ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(count)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, blanks only, ties, repeated rows, one very long text, marks and many scripts."""
    rng = random.Random(5)
    long_text = " ".join(words_of(rng, 60_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \t\n\r\x0b\x0c ", "en", "s", 7),
        (4, "one", "en", "s", 3),
        (5, "One", "en", "s", 3),
        (6, "Zwei Wörter", "de", None, 11),
        (7, long_text, "en", "s", len(long_text)),
        (8, long_text + " end", "en", "s", 1),
        (9, "don't STOP now…   ok\x1cfine İstanbul ﬁn Ⅻ ½ 日本語 😀 é <|endoftext|> x<|startoftext|>y", "xx", "s", 2),
        (9, "don't STOP now…   ok\x1cfine İstanbul ﬁn Ⅻ ½ 日本語 😀 é <|endoftext|> x<|startoftext|>y", "xx", "s", 2),
        (10, "the same text for two of them, word by word", "en", "s", 1),
        (11, "the same text for two of them, word by word", "en", "s", 1),
        (None, "the same text for two of them, word by word", "en", "s", 1),
        (None, None, None, None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
