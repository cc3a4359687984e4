import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those inside the operators."""
    long_ = " ".join(f"word{k % 997}x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "no number here at all"), (5, long_), (6, "x" * 50_000),
            (7, "One two, three four\nfive six seven\n\none two three four"), (8, "   \n\t "), (9, "<|endoftext|> in the text <|endoftext|>"), (10, "Zürich naïve ÉCOLE 日本語   tail\x85end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n_chars": F.length("text").cast("long"), "lang": F.lit("en"), "source": F.lit("s"), "ids": F.lit(1), "fp": F.lit("f"), "th": F.lit(0), "id": F.lit("i"), "row": F.lit(1), "score": F.lit("s"), "gone": F.lit(2), "lines": F.lit("l")})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
