import random

import pytest


@pytest.fixture
def documents(spark):
    """rows of (doc_id, text) -> documents with the other columns, and some that clash with inner names."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'en' AS lang", "'src' AS source", "cast(length(text) AS long) AS n_chars", "1 AS n", "2 AS count", "3 AS bucket", "4 AS node", "5 AS component", "6 AS start", "7 AS term", "8 AS h")

    return make


def some_text(rng: random.Random, words: int, vocabulary: int = 500) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture
def odd_texts():
    """Null, empty, blank, one word, marks alone, a very long text and a text with odd characters."""
    long = some_text(random.Random(1), 20_000, 10**6)
    return [None, "", " \n\t ", "word", "... !!! ---", long, "Ünïcode ﬁ 日本語 😀 \x00 \x85 a b c d e f g h i j k l m n o p", "same same same same same same same same same same same same same same same same"]
