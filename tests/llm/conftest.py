import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and then it rests a while.", "digest", 1),
        (2, "The quick brown fox jumps over the lazy dog and  then it rests a while.", None, None),
        (3, None, "x", 3), (4, "", "y", 4), (5, " \t\n ", None, 5), (6, long, "long", 6), (7, long, "long", 7),
        (8, "One two", "a", 8), (8, "One two", "a", 8), (None, "A text without an id that is long enough to count as a document.", "b", 9),
        (9, "naïve café — 中文 текст 😀 <|endoftext|> it's 3.14!", "c", 10), (10, "\x00\x1c odd space", "d", 11),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("row", T.LongType())])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
