import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """A frame of documents from (id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t else None) for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture
def odd_documents(documents):
    """Nulls in either column, empty and blank texts, repeated rows, a very long text."""
    long_text = " ".join(f"w{i}" for i in range(60_000))
    return documents([(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "one two three four five six"), (5, long_text), (6, "één ünï 漢字 \U0001f600")])
