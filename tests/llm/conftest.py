import pytest
from pyspark.sql import types as T

LONG_LINE = " ".join(f"word{i * 7919 % 1000}x{i}" for i in range(6000))

#: Null and empty texts, null and repeated ids, repeated rows, ties, very long texts and words, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank, again and again.\nAnother line of this text is here."),
    (2, None),
    (3, ""),
    (4, " \t\n \n"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank, again and again.\nAnother line of this text is here."),
    (5, "The quick brown fox jumps over the lazy dog near the river bank, again and again.\nAnother line of this text is here."),
    (5, "A different text under the same id, which talks about ships, harbours and the sea beyond them."),
    (None, "A row without an id still has words of its own, quite a few of them in fact."),
    (None, "A row without an id still has words of its own, quite a few of them in fact."),
    (6, LONG_LINE),
    (7, LONG_LINE + " and a little more"),
    (8, "x" * 150_000),
    (9, "日本語のテキスト 🙂🙂 étude ΣΊΣΥΦΟΣ   naïve\r\nmail a.b@c.example.org or call +1 (212) 555-0100, card 4111 1111 1111 1111"),
    (10, "\n\n\n!!! ... 12345 ???\n"),
    (11, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with further columns whose names the operators use inside."""
    names = ["copy", "key", "id", "_id", "lost", "rank", "bits", "spans", "words", "term", "position", "bytes", "row", "n", "lang", "source", "n_chars"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(i, t, *names) for i, t in ROWS], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(small):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()
