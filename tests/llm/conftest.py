import pytest
from pyspark.sql import functions as F

#: Nulls, empties, white space, ties, repeated rows, a shared id, no id, other scripts.
ROWS = [
    (1, "The cat sat on the mat and looked at the rain for a long time."),
    (2, "The cat sat on the mat and looked at the rain for a long time."),
    (2, "The cat sat on the mat and looked at the rain for a long time."),
    (3, None),
    (4, ""),
    (5, " \n\t \n"),
    (6, "!!! ???"),
    (7, "word"),
    (None, "A text without an id, which nobody can refer to."),
    (None, None),
    (8, "日本語のテキスト 😀 und Größe\n\nÉtat naïf"),
    (9, "same id"),
    (9, "same id, other text"),
    (10, "x" * 9000 + " y" * 6000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward rows, with columns named as operators name theirs."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    clash = ["group_id", "n", "fp", "band", "a", "b", "version", "place", "head", "shard", "rule", "start", "count", "word", "license", "path", "dir", "score", "votes", "quality", "lines", "term", "slice", "rank", "lang"]
    return df.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), *(F.lit("other").alias(c) for c in clash))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def as_set(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="session")
def rows_of():
    return as_set
