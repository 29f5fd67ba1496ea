import pytest
from pyspark.sql import functions as F

ODD = [  # doc_id, text, source: nulls, empty and wordless texts, repeats, ties, a very long text
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank today.", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the quiet river bank today.", "a"),
    (3, None, "a"), (4, "", None), (5, "!!! ... ???", None), (6, "one two", "b"), (6, "one two", "b"),
    (None, "A text without an id that nobody else has written before now.", "b"),
    (9, "\n\n  \n", "b"), (10, "é à ü ñ — “quoted” ♥ <|endoftext|> it's we'll 3.5km", None),
    (11, "long words " * 30_000, "c"),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from graphwright.llm.common import ship_package
    ship_package(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, source string")
    for name in ("key", "score", "_n", "_keep", "_hit", "_block", "_source", "sketch", "n_tokens", "start", "share", "family"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
